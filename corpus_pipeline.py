"""The corpus pipeline: documents in, packed training sequences out.

Quality rules and toxicity drop documents, near-dedup keeps one of each group, the secret scan replaces what it finds,
and packing deals all that is left to windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliate.llm import minhash, packing, quality, secret_scan, toxicity
from foliate.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, 80 %."""
    return minhash.keep_one(docs, minhash.Params())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near_dedup", near_copies),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: SQL cannot express the labelled model, the near-dedup or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
