"""Sinks that refuse to overwrite, content-addressed texts, sweep tables, corpus indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import noisy

# The columns of a sweep table, in order
SWEEP = (
    "id", "url", "shelfmark", "century", "language", "script", "items", "dimensions_mm", "area_mm2", "images", "title", "notes", "headline",
    "online_since", "scope", "found_in", "terms", "snippet",
)


def create_new(df: DataFrame, path: str) -> None:
    """Parquet at a path where nothing is yet."""
    df.write.mode("errorifexists").parquet(path)


def add_texts(store: str, docs: DataFrame) -> DataFrame:
    """Adds documents (doc_id, text, source) to a content-addressed store (a single writer) and returns what was new.

    A known text under a known id is skipped, another text under a known id is an error, equal texts are kept once."""
    spark = docs.sparkSession
    new = docs.withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    try:
        have = spark.read.parquet(f"{store}/documents")
    except Exception as e:  # an empty store has no documents yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], "doc_id string, source string, sha256 string")
    clash = new.select("doc_id", "sha256").join(have.select("doc_id", F.col("sha256").alias("old")), "doc_id").where("sha256 <> old").first()
    if clash:
        raise ValueError(f"{clash['doc_id']} is in the store with another text")
    fresh = new.join(have.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    known = have.select("sha256").distinct()
    fresh.select("sha256", "text").dropDuplicates(["sha256"]).join(known, "sha256", "left_anti").write.mode("append").parquet(f"{store}/texts")
    fresh.select("doc_id", "source", "sha256").write.mode("append").parquet(f"{store}/documents")
    return fresh.select("doc_id", "sha256")


def sweep_table(rows: DataFrame, path: str) -> None:
    """One CSV file in order of the ids; lists are joined by "; "."""
    kinds = dict(rows.dtypes)
    cols = [(F.array_join(c, "; ") if kinds.get(c, "").startswith("array") else F.col(c) if c in kinds else F.lit("")).cast("string").alias(c) for c in SWEEP]
    rows.select(*cols).orderBy("id").coalesce(1).write.mode("errorifexists").options(header=True, escape='"').csv(path)


def index(docs: DataFrame, path: str, least: int = 3) -> None:
    """Word counts (exact, ``least`` and more kept) and documents by shelfmark, for searches and for ``noisy.context``."""
    noisy.frequencies(docs.withColumnRenamed("shelfmark", "doc_id")).where(F.col("n") >= least).write.mode("errorifexists").parquet(f"{path}/frequencies")
    docs.write.mode("errorifexists").partitionBy("part").parquet(f"{path}/documents") if "part" in docs.columns else docs.write.mode("errorifexists").parquet(f"{path}/documents")
