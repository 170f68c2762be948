"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next. A stage begins by deleting what the earlier ones left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, mixing, quality_rules, simhash, suffix_dedup
from lectern.llm.common import materialize, sweep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return quality_rules.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return simhash.stage(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return suffix_dedup.stage(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return decontaminate.stage(spark, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return mixing.stage(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("poisson_mixing", mix),
]

#: Robust estimates, fingerprints and edit distances aren't expressible in SQL; tests/llm compares brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
