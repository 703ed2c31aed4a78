"""Roll-ups of entries to archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def inspect(entries: DataFrame) -> DataFrame:
    """A row for each archive: counts, sizes (null where an entry's is unknown), solid
    streams, encryption, completeness, and the archive's comment, version and bytes."""
    w = Window.partitionBy("archive_path").orderBy("entry_index")
    before = F.coalesce(F.lag("is_solid").over(w), F.lit(False))
    # Solid runs of entries in order; folders of more than one entry count once each.
    marked = entries.withColumn("_run", (F.col("is_solid") & ~before).cast("int"))
    unknown = F.col("size").isNull() & ~F.col("is_directory")
    told = (lambda k: F.first(F.col("format_meta")[k], True)) if "format_meta" in entries.columns else (lambda k: F.first(F.lit(None).cast("string")))
    return marked.groupBy("archive_path").agg(
        F.first("archive_type", True).alias("container_type"), F.first("outer_compression", True).alias("outer_compression_type"), told("format_version").alias("format_version"),
        F.count("*").alias("entry_count"), F.count(F.when(unknown, 1)).alias("entries_with_unknown_size"), told("archive_size").cast("long").alias("physical_size"),
        F.when(F.count(F.when(unknown, 1)) == 0, F.coalesce(F.sum("size"), F.lit(0))).alias("uncompressed_payload_size"),
        F.sum("compressed_size").alias("compressed_payload_size"),
        F.bool_or("is_solid").alias("is_solid"), F.sum("_run").alias("solid_stream_count"),
        F.bool_or("is_encrypted").alias("is_encrypted"), told("encryption").alias("encryption"), F.bool_and("is_complete").alias("is_complete"),
        F.when(F.bool_or("is_encrypted"), "EntryData").otherwise("None").alias("encryption_scope"),
        F.when(F.bool_and("is_complete"), "Complete").otherwise("Partial").alias("status"), told("archive_comment").alias("comment"),
        F.when(F.bool_and("is_complete") & (F.count(F.when(unknown, 1)) == 0), "None").when(F.bool_and("is_complete"), "UnavailableMetadata").otherwise("MissingVolumes").alias("limitations"),
        (F.max("volume_index_last") > 0).alias("is_multi_volume"), (F.max("volume_index_last") + 1).alias("physical_part_count"),
        (F.max("volume_index_last") + 1).alias("logical_volume_count"),
    )


def solid_folders(entries: DataFrame) -> DataFrame:
    """Folders that several entries share, by archive."""
    return entries.filter("folder is not null").groupBy("archive_path", "folder").agg(F.count("*").alias("entries"), F.sum("size").alias("size")).filter("entries > 1")


def first_in_folder(entries: DataFrame) -> DataFrame:
    """is_solid by position: every entry but the first of its folder."""
    w = Window.partitionBy("archive_path", "folder").orderBy("entry_index")
    return entries.withColumn("is_solid", F.col("folder").isNotNull() & (F.row_number().over(w) > 1))


def quarantined(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries read under onError "null": those without an error, and those with one."""
    return entries.filter("error is null"), entries.filter("error is not null")


def watched(entries: DataFrame, name: str | Observation) -> DataFrame:
    """entries, with the counts of what has gone through as an observation of that name:
    progress for listeners of batch and streaming queries."""
    size = F.coalesce(F.sum(F.octet_length("content")), F.lit(0)) if "content" in entries.columns else F.coalesce(F.sum("size"), F.lit(0))
    return entries.observe(name, F.count("*").alias("entries"), size.alias("bytes"), F.count("error").alias("errors"))
