"""A corpus from documents in five stages: quality rules, one document of each near-duplicate group, no benchmark items, no secrets, token ids.

All stages but the last return the columns of documents; the last returns the ids and tokens of each document that is left.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontamination, quality, secrets, simhash
from tidelog.llm.common import shared_folder, table
from tidelog.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_unlike(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"), reworded=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", redact_secrets), ("BPE encoding and decoding", encode)]

#: SQL can't express SimHash components, nor byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each result is written as Parquet to the session's shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_folder(spark).rstrip('/')}/pipeline-{os.urandom(8).hex()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
