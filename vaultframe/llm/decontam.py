"""Benchmark decontamination, in DataFrame functions alone.

The hashes of the benchmark's windows are collected once, under a checked bound, and
become a hash set inside the plan: each training text is split into words and hashed
once, every window's hash is looked up within the row, and only the windows found leave
the row as words to be verified against the benchmark's own. Beyond the bound the
windows' hashes, 8 bytes each, are joined with the benchmark's instead, with the same
result. Texts never shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import written

#: Words of a window.
WINDOW = 10
#: Benchmark windows that may travel inside the plan; a larger benchmark is joined.
MAX_WINDOWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z lowered, runs of letters, digits and what isn't ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _at(words: Column, i: Column, k: int) -> Column:
    return F.slice(words, i, k)


def _starts(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, k, gram): each item's windows; an item of fewer words, but not none, is
    one window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    k = F.least(F.lit(window), F.col("n"))
    return w.select("item_id", k.alias("k"), "w", F.explode(F.sequence(F.lit(1), F.col("n") - k + 1)).alias("i")).select("item_id", "k", F.expr("slice(w, i, k)").alias("gram")).distinct()


def _hash(hashed: Column) -> Column:
    return F.xxhash64(hashed)


def _found(k: int, known: list[int]) -> Column:
    """The windows of k words whose hash is known. The hashes are named twice here, so
    that the optimizer keeps them as a column and doesn't make them anew for each i."""
    w, h = F.col("_w"), F.col("_h")
    at = F.filter(_starts(F.size(h), k), lambda i: _hash(_at(h, i, k)).isin(known))
    return F.transform(at, lambda i: F.struct(i.alias("i"), _at(w, i, k).alias("gram")))


def _every(k: int) -> Column:
    h = F.col("_h")
    return F.transform(_starts(F.size(h), k), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), _hash(_at(h, i, k)).alias("h")))


def _hits(docs: DataFrame, grams: DataFrame, max_windows: int) -> DataFrame:
    """docs with n_words and hits, an array of (i, gram): the windows of the text that
    are windows of the benchmark."""
    sets = grams.select("k", _hash(F.transform("gram", lambda x: F.xxhash64(x))).alias("h")).distinct().limit(max_windows + 1).collect()
    by: dict[int, list[int]] = {}
    for k, h in sets:
        by.setdefault(k, []).append(h)
    split = docs.withColumn("_w", words(F.col("text"))).withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    if len(sets) <= max_windows:
        found = [_found(k, by[k]) for k in sorted(by)]
        hits = F.concat(*found) if found else F.array().cast("array<struct<i:int,gram:array<string>>>")
        return split.withColumn("hits", hits).drop("_w", "_h")
    keyed = written(split.withColumn("_row", F.monotonically_increasing_id()), "split")
    # Only the row's number goes with each window, so a long text is not copied for each.
    keys = grams.select("k", _hash(F.transform("gram", lambda x: F.xxhash64(x))).alias("h")).distinct()
    each = keyed.select("_row", F.explode(F.concat(*map(_every, sorted(r[0] for r in grams.select("k").distinct().collect())))).alias("x")).select("_row", "x.*")
    met = each.join(keys, ["k", "h"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("i", "k")).alias("_met"))
    words_of = F.transform(F.coalesce("_met", F.array().cast("array<struct<i:int,k:int>>")), lambda x: F.struct(x.i.alias("i"), F.slice("_w", x.i, x.k).alias("gram")))
    return keyed.join(met, "_row", "left").withColumn("hits", words_of).drop("_w", "_h", "_row", "_met")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs (doc_id, text, ...) against benchmark (item_id, text, ...) -> doc_id, n_words,
    n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the item
    ids, sorted as strings and joined by commas), contaminated.

    A row for each row of docs, also for repeated ones, whole texts however long; nulls
    and empty texts have no words and are clean. Items without an item_id count as one
    item of no name: their words are hit, the digest leaves them out. An empty benchmark
    leaves all clean, empty docs give an empty result. Other columns, of any name, are
    ignored."""
    grams = benchmark_windows(benchmark, window)
    base = written(_hits(docs.select("doc_id", "text"), grams, max_windows).drop("text").withColumn("_row", F.monotonically_increasing_id()), "windows")
    items = grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless"))
    met = base.filter(F.size("hits") > 0).select("_row", F.inline("hits")).join(items, "gram")
    spans = F.array_sort(F.collect_list(F.struct("i", (F.col("i") + F.size("gram")).alias("end"))))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a.end, x.end).alias("end"), (a.n + F.greatest(F.lit(0), x.end - F.greatest(x.i, a.end))).alias("n")),
        lambda a: a.n.cast("long"),
    )
    hit = met.groupBy("_row").agg(merged.alias("n_hit"), F.max("nameless").alias("nameless"))
    # An item that a text has many windows of is one row before names are gathered.
    own = met.select("_row", F.explode("items").alias("item")).distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("names"))
    out = base.select("_row", "doc_id", "n_words").join(hit, "_row", "left").join(own, "_row", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    n_items = (F.size(names) + F.coalesce("nameless", F.lit(0))).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of docs, all columns of whatever names, whose text holds no window of the
    benchmark, items without an item_id included. A null or empty text holds none;
    repeated rows stay or go together; empty tables take nothing away."""
    grams = benchmark_windows(benchmark, window)
    texts = [r[0] for r in grams.select(F.array_join("gram", " ")).distinct().limit(max_windows + 1).collect()]
    others = [c for c in docs.columns if c != "text"]
    marked = _hits(docs.select(F.struct(*others).alias("_rest"), "text"), grams, max_windows)
    back = [F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns]
    if len(texts) > max_windows:
        marked = written(marked.withColumn("_row", F.monotonically_increasing_id()), "marked")
        sure = marked.select("_row", F.inline("hits")).join(grams.select("gram").distinct(), "gram", "left_semi").select("_row").distinct()
        return marked.join(sure, "_row", "left_anti").select(*back)
    if texts:
        marked = marked.withColumn("hits", F.filter("hits", lambda x: F.array_join(x.gram, " ").isin(texts)))
    # A column of no fixed value keeps the optimizer from pushing the filter, and with it
    # a copy of every expression that it names, below the columns made here.
    marked = marked.withColumn("_row", F.monotonically_increasing_id())
    return marked.filter((F.size("hits") == 0) & (F.col("_row") >= 0)).select(*back)


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(gram) AS k FROM g),
s AS (
  SELECT r, i, k, w[i:i + k - 1] AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
m AS (SELECT s.r, s.i, s.k, g.item_id FROM s JOIN g ON s.gram = g.gram),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r
"""
