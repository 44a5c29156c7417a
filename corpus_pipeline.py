"""The corpus pipeline: documents through quality rules, near-dedup, secrets, mixing, packing.

Every stage works on all that the one before it kept.  The first four return the columns of
documents; the last returns packed pieces.

* quality: documents outside the fences of their language and source go.
* near_copies: of texts alike at five-word Jaccard 0.8 or more one stays, the smallest doc_id.
* secrets: spans of secrets are replaced by their kind; no document goes.
* mixture: sources are taken to their target weights; a document taken twice is two rows.
* packing: token pieces in windows of 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import mixing, near_copies, packing, quality, secret_scan
from feedloom.session import settle

EPOCHS = 2  # most often that the mixture takes a document


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, epochs=EPOCHS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

# Quantile sketches, shingle sets and the tokenizer are not SQL: the stages are tested
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
