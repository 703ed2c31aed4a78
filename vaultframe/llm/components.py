"""Connected components of a link table: union-find within each partition, then the
alternation of large and small stars over the contracted links until nothing changes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import UnionFind, tidy, written

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Keys of more than one in SHARE of all rows are hot; there are at most SHARE of these.
SHARE = 1000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the smallest node of each of its trees."""
    found = UnionFind()
    for x in batches:
        for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True):
            found.join(a, b)
        if len(found.up) > 200_000:
            yield from _stars(found)
            found = UnionFind()
    yield from _stars(found)


def _stars(found: UnionFind) -> Iterator[pa.RecordBatch]:
    nodes = list(found.up)
    roots = [found.find(x) for x in nodes]
    keep = [(a, r) for a, r in zip(nodes, roots, strict=True) if a != r]
    if keep:
        a, b = zip(*keep, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def hot_join(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with facts (one row for each key, n: how many of the total rows have
    it). Keys of more than one in SHARE of the rows, of which there can only be SHARE,
    go by broadcast, all others by shuffle; so no task gets all rows of a hot key."""
    bound = max(1, total // SHARE)
    hubs = F.broadcast(facts.filter(F.col("n") > bound).drop("n"))
    others = facts.filter(F.col("n") <= bound).drop("n")
    return rows.join(hubs, on).unionByName(rows.join(hubs.select(*on), on, "left_anti").join(others, on))


def components(links: DataFrame) -> DataFrame:
    """links (a, b long) -> (node, component): component is the smallest node reachable.
    Nodes without links do not appear; nulls and self-links are ignored, repeated links
    count once. An empty table gives an empty result. Rounds go on until none changes
    anything, however long the chains."""
    links = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    links = written(links.mapInArrow(_contract, "a long, b long"), "links")
    before = _state(links)
    while True:
        total = before[0]
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, ["a"], 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))  # hubs are smaller than what they link
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        links = written(small, "stars")
        now = _state(links)
        tidy(links.sparkSession)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
