"""Archives that arrive in a folder, exploded into entries as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultframe.sources.archive import explode_archives

FILES = "path string, modificationTime timestamp, length long, content binary"


def entries_stream(spark: SparkSession, path: str, content: bool = True, on_error: str = "null", glob: str = "*", **options: str) -> DataFrame:
    """A streaming DataFrame of the entries of each new archive below path. A damaged
    archive is a row with its error rather than the end of the stream."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return explode_archives(files, content, on_error, **options)
