"""The queries opN_<name>, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_spans, licenses, manifest, mixing, oracles, quality, repair, secrets, simhash, token_counts, url_filter, warc
from .common import table


def vocabulary(name: str) -> str:
    """The JSON text of an installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_spans.remove_repeats(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica in which one character of every 97th record is damaged."""
    recs = warc.records(table(spark, sf_dir, "pages"))
    hurt = F.concat(F.substring("record", 1, 299), F.lit("#"), F.substring("record", F.lit(301), F.length("record")))
    replica = recs.withColumn("record", F.when(F.pmod("id", F.lit(97)) == 13, hurt).otherwise(F.col("record")))
    return warc.audit(recs, replica)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), reworded=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("key")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_suffix_dedup, op2_token_counts, op3_simhash, op4_licenses, op5_secrets, op6_url_filter, op7_quality, op8_bpe, op9_warc_audit, op10_decontamination, op11_conversation_repair, op12_mix_sources, op13_merkle_manifest)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
