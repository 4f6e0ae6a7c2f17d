"""The corpus pipeline: raw documents become packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from residua.llm import decontaminate, packing, pii, quality, simhash
from residua.llm.texts import stored
from residua.plans.registry import table


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``like``; n_chars, where it is one, follows a changed text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines are removed, rejected documents dropped."""
    return _recounted(quality.keep_good(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return simhash.keep_one(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages are a twentieth of the words or more are dropped."""
    kept = decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _recounted(pii.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go; copies that are left share a cluster and no bin."""
    return packing.pack(docs.select(
        "doc_id", "source", F.xxhash64("text").alias("cluster"), packing.count_tokens("text").alias("n_tokens")))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

# trees, fingerprints and best-fit bins are not expressible in SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
