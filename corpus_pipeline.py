"""The corpus pipeline: documents through five operators, each over all that the one
before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultframe.llm import decontam, mixing, near_dedup, quality_crf, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_crf.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Percent of five-word shingles in common from which two documents are near copies; 85
#: holds for op9_near_dedup alone.
NEAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    gone = near_dedup.near_duplicates(docs, percent=NEAR).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once go from the texts."""
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with the words it takes of each."""
    return mixing.mixed(docs).filter("taken > 0")


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The classifier and the seeded mix can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again by the next."""
    from vaultframe.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
