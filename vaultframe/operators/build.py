"""Rows to archives, grouped: the engine's aggregate from entries to one binary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.sources.writers import Item, WriteOptions, write


def build_archives(entries: DataFrame, by: str, kind: str | Callable[[list[Item]], bytes] = "zip", options: WriteOptions = WriteOptions(), order: str = "key") -> DataFrame:
    """entries (by, key, content, and perhaps is_directory, last_modified, codec, level,
    comment) -> (by, archive binary, n_entries). One archive for each value of by, its entries by
    order; an archive must fit in a binary cell. A null content is an empty file. kind: a
    format that is written, or what makes an archive of items."""
    names = entries.columns
    arrow = pa.schema([("by", pa.string()), ("archive", pa.binary()), ("n_entries", pa.int64())])

    def flush(group: str, items: list[Item]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([kind(items) if callable(kind) else write(kind, items, options)], pa.binary()), pa.array([len(items)], pa.int64())], schema=arrow)

    def step(batches) -> Iterator[pa.RecordBatch]:
        group, items = None, []
        for b in batches:
            for r in b.to_pylist():
                if items and r["_by"] != group:
                    yield flush(group, items)
                    items = []
                group = r["_by"]
                items.append(Item(r["key"], None if r.get("is_directory") else r["content"] or b"", r.get("last_modified"), r.get("codec"), r.get("level"), r.get("comment") or ""))
        if items:
            yield flush(group, items)

    keep = [c for c in ("key", "content", "is_directory", "last_modified", "codec", "level", "comment") if c in names]
    sorted_ = entries.select(F.col(by).cast("string").alias("_by"), *keep, *([order] if order not in keep else [])).repartition("_by").sortWithinPartitions("_by", order)
    return sorted_.mapInArrow(step, "by string, archive binary, n_entries long").withColumnRenamed("by", by)
