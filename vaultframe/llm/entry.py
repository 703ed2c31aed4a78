"""Queries of the corpus operators, each over its whole table with production
parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaultframe.llm import decontam


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vaultframe.llm.token_counts import token_counts

    return token_counts(_docs(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.mixing import mixed

    return mixed(_docs(spark, sf_dir), columns=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.decontam import contamination

    return contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.quality_rules import judged

    return judged(_docs(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.quality_crf import scored

    return scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.toxicity import scored

    return scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.lm_hpyp import scored

    return scored(_docs(spark, sf_dir))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.suffix_dedup import removed

    return removed(_docs(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vaultframe.llm.licenses import scanned

    return scanned(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_source_mix": op4_source_mix,
    "op5_language_model": op5_language_model,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op7_decontamination": decontam.SQL}
