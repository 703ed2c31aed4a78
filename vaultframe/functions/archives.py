"""Archives as columns: their type, and a table function over their entries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.sources import detect
from vaultframe.sources.archive import rows_of
from vaultframe.sources.model import CONTENT, Options

#: First bytes of formats that these alone tell.
MAGIC = (
    ("Zip", "504B0304"), ("Zip", "504B0506"), ("Zip", "504B3030"), ("Zip", "504B0708"), ("Rar", "526172211A07"), ("SevenZip", "377ABCAF271C"),
)


def detected(content: Column) -> Column:
    """struct(archive_type, outer_compression) of a binary column; nulls if it is none."""

    @F.pandas_udf("archive_type string, outer_compression string")
    def run(s: pd.Series) -> pd.DataFrame:
        kinds = [None if x is None else detect.detect(bytes(x)) for x in s]
        return pd.DataFrame({"archive_type": kinds, "outer_compression": [None if k is None else detect.outer_compression(bytes(x)) if k == "Tar" else "None" for k, x in zip(kinds, s, strict=True)]})

    return run(content)


def archive_type(content: Column) -> Column:
    """Name of the format, null if none. What its first bytes settle stays in the JVM;
    the rest, which needs a tar's checksum or the start of what a codec wraps, goes to
    Python as a prefix of the content."""
    known = None
    for name, magic in MAGIC:
        test = F.substring(content, 1, len(magic) // 2) == F.lit(bytes.fromhex(magic))
        known = F.when(test, name) if known is None else known.when(test, name)
    return known.otherwise(detected(F.when(known.isNull(), F.substring(content, 1, detect.HEAD))).archive_type)


def is_archive(content: Column) -> Column:
    return archive_type(content).isNotNull()


#: How each format can be read: entry by entry at will, or forward alone.
ACCESS = {"Zip": "Archive,Reader", "Rar": "Archive,Reader", "Tar": "Archive,Reader", "GZip": "Archive,Reader", "SevenZip": "Archive", "Lzw": "Reader", "Arc": "Reader", "Arj": "Reader", "Ace": "Reader"}


def detect_archive(content: Column) -> Column:
    """struct(container_type, format_name, outer_compression_type, supported_apis) of a
    binary column; a compressed tar is read forward alone. Nulls if it is no archive."""
    d = detected(content)
    kind, outer = d.archive_type, d.outer_compression
    apis = F.create_map(*(F.lit(x) for pair in ACCESS.items() for x in pair))[kind]
    apis = F.when((kind == "Tar") & (outer != "None"), "Reader").otherwise(F.coalesce(apis, F.lit("Reader")))
    return F.when(kind.isNotNull(), F.struct(kind.alias("container_type"), kind.alias("format_name"), outer.alias("outer_compression_type"), F.split(apis, ",").alias("supported_apis")))


def file_parts(files: DataFrame) -> DataFrame:
    """files (path, ...) -> whole, part, place: which archive each file is a part of, and
    where in it."""

    @F.pandas_udf("whole string, place int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect.volume_of(x) for x in s], columns=["whole", "place"])

    return files.select(F.col("path").alias("part"), run("path").alias("v")).select("v.whole", "part", "v.place")


class _Entries:
    """Rows of an archive, for SQL: FROM t, LATERAL archive_entries(t.content)."""

    def eval(self, content: bytes):
        if content is not None:
            for r in rows_of("", bytes(content), Options(), True):
                yield r[1:]


def register_functions(spark: SparkSession) -> None:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CONTENT.fields[1:])
    spark.udtf.register("archive_entries", F.udtf(_Entries, returnType=schema))


def directory_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder as rows for the writers: key relative to it, content, and
    last_modified."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", root, -1).alias("key"), "content", F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"))
