"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that list them); the
patterns' capacities, once for each repetition and dearer each time, are routed to the
sources' quotas by successive shortest paths on that small graph; and each pattern's
flow is taken from its documents in a seeded order. Only pattern sums reach the driver."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.llm.common import written

#: Weights of the sources in order, repeating; share of all sizes; repetitions at most.
WEIGHTS, RATIO, REPEATS = (5, 2, 1), 1.5, 2
#: Columns that the mix adds.
RESULTS = ("size", "source_size", "target", "taken")
#: Distinct membership patterns that may reach the driver.
MAX_PATTERNS = 100_000
#: A pattern's documents are dealt into so many buckets of its seeded order.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, repeats: int = REPEATS) -> list[float]:
    """Quota of each source, in order: shares by weight of ratio times all sizes, no
    more than repeats times a source's own size, the excess shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left = [0.0] * len(sizes), ratio * sum(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def route(sizes: list[int], members: list[tuple[int, ...]], quotas: list[float], repeats: int = REPEATS) -> list[list[float]]:
    """Words that each pattern gives to each source, of least cost: the r-th repetition
    of a word costs r. Successive shortest paths over pattern and source nodes."""
    n, m = len(sizes), len(quotas)
    flow = [[0.0] * m for _ in range(n)]
    used, need = [0.0] * n, list(quotas)
    by_source: list[list[int]] = [[] for _ in range(m)]
    for p, own in enumerate(members):
        for s in own:
            by_source[s].append(p)
    for turn in range(repeats):  # costs rise by the turn, so all of a turn is taken first
        room = [max(0.0, (turn + 1) * sizes[p] - used[p]) for p in range(n)]
        for s in sorted(range(m), key=lambda s: len(by_source[s])):
            while need[s] > 1e-6:
                # Breadth first from s to a pattern with room, over patterns that can be released from another source.
                back: dict[tuple[str, int], tuple[str, int]] = {("s", s): ("", -1)}
                queue, end = [("s", s)], None
                for kind, x in queue:
                    if kind == "s":
                        for p in by_source[x]:
                            if ("p", p) not in back:
                                back["p", p] = (kind, x)
                                queue.append(("p", p))
                                if room[p] > 1e-9:
                                    end = ("p", p)
                                    break
                        if end:
                            break
                    else:
                        for t in members[x]:
                            if ("s", t) not in back and flow[x][t] > 1e-9:
                                back["s", t] = (kind, x)
                                queue.append(("s", t))
                if end is None:
                    break
                path = [end]
                while path[-1] != ("s", s):
                    path.append(back[path[-1]])
                path.reverse()  # s, p, t, p', t', ..., pattern with room
                amount = min(need[s], room[path[-1][1]], *(flow[path[i][1]][path[i + 1][1]] for i in range(1, len(path) - 1, 2)))
                for i in range(0, len(path) - 1, 2):
                    flow[path[i + 1][1]][path[i][1]] += amount
                    if i:
                        flow[path[i - 1][1]][path[i][1]] -= amount
                need[s] -= amount
                room[path[-1][1]] -= amount
                used[path[-1][1]] += amount
    return flow


def mixed(docs: DataFrame, members: Column | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, repeats: int = REPEATS, columns: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> docs' columns (or those named) with size, source_size, target
    and taken.

    members: an array of the sources that list a document; by default source alone, a
    null source being one of its own, sorted last. size counts the words, a null or
    empty text has none and is never taken. Each pattern's documents are taken whole as
    often as the flow covers all of them, then once more in an order seeded by doc_id;
    the last one is cut where the flow ends, so that a source's words meet its target.
    target and source_size are those of the first of a document's sources. Reruns
    agree; columns of docs that have the results' names are left out; rows that share a doc_id are ordered by size. An empty table stays empty. Sizes
    are of whole texts, however long."""
    by = members if members is not None else F.array("source")
    columns = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    key = F.transform(F.array_sort(F.array_distinct(by)), lambda x: F.concat(F.lit("="), x))
    pattern = F.to_json(F.transform(key, lambda x: F.coalesce(x, F.lit("-"))))
    # The order of a pattern's rows, in 32 bits, and its bucket.
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rest = F.struct(*(F.col(c) for c in columns if c != "text"))
    sized = docs.select(rest.alias("_others"), *(["text"] if "text" in columns else []), "doc_id", word_count(F.col("text")).alias("size"), pattern.alias("_pattern"), order.alias("_order"), F.pmod(F.shiftright(order, 40), F.lit(BUCKETS)).cast("int").alias("_bucket"))
    if "text" in columns:  # the texts are read again rather than written
        small = written(sized.select("doc_id", "size", "_pattern", "_order", "_bucket"), "sizes")
    else:
        small = sized = written(sized, "sizes")
    sums = small.groupBy("_pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = [(r[0], json.loads(r[0]), int(r[1])) for r in sums]
    patterns.sort(key=lambda p: p[1])
    names = sorted({s for _, own, _ in patterns for s in own}, key=lambda s: (s == "-", s))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for _, own, size in patterns:
        for s in own:
            sizes[at[s]] += size
    quotas = targets(sizes, weights, ratio, repeats)
    flow = route([p[2] for p in patterns], [tuple(at[s] for s in own) for _, own, _ in patterns], quotas, repeats)
    rows = []
    for (name, own, size), f in zip(patterns, flow, strict=True):
        give = min(repeats * size, math.floor(sum(f) + 0.5))
        full = give // size if size else 0
        s = min((at[x] for x in own), default=None)
        rows.append((name, full, give - full * size, None if s is None else sizes[s], None if s is None else quotas[s]))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "_pattern string, _full long, _rest long, source_size long, target double")
    # The bucket in which the seeded order reaches _rest, and how much is left there.
    cells = small.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("s"))
    so_far = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("s").over(so_far), F.lit(0))).drop("s")
    in_cell = Window.partitionBy("_pattern", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = small.join(F.broadcast(plan.select("_pattern", "_rest")), "_pattern").join(cells, ["_pattern", "_bucket"])
    edge = cells.join(F.broadcast(plan.select("_pattern", "_rest")), "_pattern").groupBy("_pattern").agg(F.max(F.when(F.col("_before") < F.col("_rest"), F.col("_bucket"))).alias("_edge"))
    cut = cut.join(F.broadcast(edge), "_pattern")
    return _select(sized, cut, plan, edge, in_cell, columns)


def _select(sized: DataFrame, cut: DataFrame, plan: DataFrame, edge: DataFrame, in_cell, columns: list[str]) -> DataFrame:
    """Buckets below the edge are taken, those above are not; within the edge bucket the
    rows' running sums decide."""
    spark = sized.sparkSession
    inside = cut.filter("_bucket = _edge").withColumn("_ahead", F.col("_before") + F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    # Where the order stands when _rest is used up: the first row that isn't taken whole.
    stop = inside.filter("_ahead + size > _rest").groupBy("_pattern").agg(F.min(F.struct("_order", "doc_id", "size", "_ahead")).alias("_stop"))
    whole = plan.join(edge, "_pattern", "left").join(stop, "_pattern", "left")
    facts = spark.createDataFrame(whole.collect(), whole.schema)  # a row for each pattern
    here = F.struct("_order", "doc_id", "size")
    there = F.struct(F.col("_stop._order").alias("_order"), F.col("_stop.doc_id").alias("doc_id"), F.col("_stop.size").alias("size"))
    extra = (
        F.when(F.col("_edge").isNull() | (F.col("_bucket") > F.col("_edge")), F.lit(0))
        .when(F.col("_bucket") < F.col("_edge"), F.col("size"))
        .when(F.col("_stop").isNull() | (here < there), F.col("size"))
        .when(here == there, F.greatest(F.lit(0), F.col("_rest") - F.col("_stop._ahead")))
        .otherwise(F.lit(0))
    )
    taken = (F.col("_full") * F.col("size") + extra).cast("long")
    return sized.join(F.broadcast(facts), "_pattern").select(*(F.col("text") if c == "text" else F.col("_others")[c].alias(c) for c in columns), "size", "source_size", "target", taken.alias("taken"))
