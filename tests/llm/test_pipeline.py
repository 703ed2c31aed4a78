"""The pipeline's stages: each one's decisions against the operator it calls."""

import corpus_pipeline
from vaultframe.llm import decontam, near_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        rows = out.collect()
        kept[name] = (now, rows)
        if name != "mixing":
            assert [f.name for f in out.schema] == docs.columns
            now = spark.createDataFrame(rows, docs.schema)
    before, rows = kept["near_dedup"]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in near_dedup.near_duplicates(before).filter("kept").collect())
    before, rows = kept["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in decontam.contamination(before, bench).filter("not contaminated").collect())
    assert len(kept["suffix_dedup"][1]) == kept["suffix_dedup"][0].count()
    assert all(0 < r.taken <= 2 * r.size for r in kept["mixing"][1])


def test_odd_rows_and_none(spark, odd, none):
    """Null and repeated ids, null, empty and long texts, and columns whose names the
    operators use themselves: every stage keeps the columns, and whole rows."""
    for rows in (odd, none):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            before = now
            now = stage(spark, before, SF)
            if name == "mixing":
                assert set(now.columns) == set(rows.columns) | {"size", "source_size", "target", "taken"}
                break
            assert now.columns == rows.columns
            now = spark.createDataFrame(now.collect(), now.schema)
            same = [c for c in rows.columns if c not in ("text", "n_chars")]
            assert not now.select(same).exceptAll(before.select(same)).count()
        assert now.count() <= rows.count()


def test_each_stage_alone_on_odd_rows(spark, odd):
    """Stages other than the classifier, which takes most of these texts for junk."""
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count()
        if name == "suffix_dedup":
            assert out.count() == odd.count() and out.filter("text is null").count() == odd.filter("text is null").count()
        if name == "decontamination":
            assert out.count() == odd.count()
