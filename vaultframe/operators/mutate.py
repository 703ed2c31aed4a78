"""Adding and removing entries, as set algebra on the entry relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_key(col):
    """What two keys are compared by: one slash, none in front, no case."""
    return F.lower(F.regexp_replace(F.translate(col, "\\", "/"), "^/", ""))


def remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries without those of gone (archive_path, entry_index)."""
    return entries.join(gone.select("archive_path", "entry_index").distinct(), ["archive_path", "entry_index"], "left_anti").select(entries.columns)


def duplicates(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of new that an archive has already, or that new brings twice."""
    old = entries.select("archive_path", normal_key(F.col("key")).alias("k"), F.lit(0).alias("n"))
    return old.union(new.select("archive_path", normal_key(F.col("key")).alias("k"), F.lit(1).alias("n"))).groupBy("archive_path", "k").agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter("c > 1 and n > 0")


def add(entries: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """Entries, then new (archive_path, key, ...) after the last of each archive. With
    check, a key that is there already raises; without, the caller has seen to that."""
    if check and not duplicates(entries, new).isEmpty():
        raise ValueError("an entry of that key exists")
    last = entries.groupBy("archive_path").agg((F.max("entry_index") + 1).alias("_base"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("archive_path").orderBy("key")) - 1
    more = new.withColumn("key", F.regexp_replace("key", "^/", "")).withColumn("_rank", rank).join(last, "archive_path", "left").withColumn("entry_index", F.coalesce("_base", F.lit(0)) + F.col("_rank")).drop("_base", "_rank")
    return entries.unionByName(more, allowMissingColumns=True)


def replace(entries: DataFrame, new: DataFrame) -> DataFrame:
    """add(), after removing what has the new keys."""
    keys = new.select("archive_path", normal_key(F.col("key")).alias("_k")).distinct()
    kept = entries.withColumn("_k", normal_key(F.col("key"))).join(keys, ["archive_path", "_k"], "left_anti").drop("_k")
    return add(kept.select(entries.columns), new, check=False)
