"""The pipeline's near-dedup stage against grouping by hand at 0.8."""

import corpus_pipeline
from tests.llm.test_operators import grouped_by_hand, raw
from vaultframe.llm import near_dedup


def test_near_copies_at_80(spark, docs):
    w = [f"w{i}" for i in range(104)]
    other = [f"v{i}" for i in range(104)]
    # 100 shingles each: one changed word takes five of them, so 90 of 110 are shared
    # by texts of 0.82, and 85 of 115 by texts of 0.74.
    changed = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    rows = [(1, " ".join(w)), (2, changed(10, 50)), (3, " ".join(other)), (4, changed(10, 50, 90, 30, 70))]
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    for df in (made, docs):
        want = sorted(d for d, _, _, kept in grouped_by_hand(raw(df), 80) if kept)
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, made, "").collect()) == [1, 3, 4]


def test_near_stage_keeps_what_the_operator_keeps(spark, docs):
    percent = corpus_pipeline.NEAR
    want = near_dedup.near_duplicates(docs, percent=percent).filter("kept").collect()
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(r.doc_id for r in want)
