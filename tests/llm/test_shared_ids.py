"""Rows that share a doc_id, long chains of links, and clusters dealt by size."""

import numpy as np

from tests.llm.test_operators import grouped_by_hand, raw, result
from vaultframe.llm import components, near_dedup

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    made = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (7, a), (7, b + " z"), (8, ""), (8, None), (None, a)]
    for rows, limit in ((made, 50), ([(9 if i == 1 else i, t) for i, t in made], near_dedup.MAX_ELEMENTS)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(near_dedup.near_duplicates(df, max_elements=limit), *NAMES) == grouped_by_hand(raw(df))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[3] == 1


def test_clusters_dealt_by_size(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):  # one passage cut to many lengths, some words changed
        w = words[: int(rng.integers(40, 400))].copy()
        for j in rng.integers(0, len(w), int(rng.integers(0, 3))):
            w[j] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, limit in ((80, near_dedup.MAX_ELEMENTS), (80, 3000), (85, 400), (100, 400)):
        assert result(near_dedup.near_duplicates(df, percent, limit), *NAMES) == grouped_by_hand(raw(df), percent)


def test_components_of_long_chains(spark):
    chain = [(i * 11 % 301, (i + 1) * 11 % 301) for i in range(300)]
    links = spark.createDataFrame([*chain, (1000, 1001)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


def test_hot_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2 + i, i) for i in range(50)], "a long, b long")
    facts = rows.groupBy("a").count().withColumnRenamed("count", "n").selectExpr("a", "n", "a * 10 as m")
    out = components.hot_join(rows, facts, ["a"], rows.count())
    assert out.count() == rows.count() and out.filter("m <> a * 10").count() == 0
