"""Indicators of compromise over a log or a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import INDICATORS, private_ipv4
from ..functions.iocs import starts_others
from ..logframe import LogFrame


def extract(texts: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """id, kind, value: every distinct indicator of each text. Addresses inside of URLs count on their own; a domain that is an address's URL does too."""
    kinds = kinds or list(INDICATORS)
    source = F.coalesce(F.col(text_col), F.lit(""))
    one = lambda kind: F.transform(INDICATORS[kind](source), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.concat(*(one(k) for k in kinds)))).alias("i"))
    return found.select("id", "i.kind", "i.value")


def summarize(found: DataFrame) -> DataFrame:
    """kind, value, n_rows, first and last id, private (of addresses) and algorithm (of hashes)."""
    out = found.groupBy("kind", "value").agg(F.count("*").alias("n_rows"), F.min("id").alias("first"), F.max("id").alias("last"))
    size = F.length("value")
    algorithm = F.when(F.col("kind") == "hash", F.when(size == 32, "MD5").when(size == 40, "SHA1").otherwise("SHA256"))
    return out.select("*", F.when(F.col("kind") == "ipv4", private_ipv4(F.col("value"))).alias("private"), algorithm.alias("algorithm"))


def counts(found: DataFrame) -> DataFrame:
    """kind, n_values, n_rows."""
    return found.groupBy("kind").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_rows"))


def lookup(found: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Indicators whose value holds a text."""
    rows = found.where(F.lower("value").contains(text.lower()))
    return rows.where(F.col("kind") == kind) if kind else rows


def from_log(frame: LogFrame) -> DataFrame:
    """id (pos), kind, value from all fields of a log; users are indicators too, and processes whose row shows that they started something else."""
    text = frame.df.select("pos", F.concat_ws(" ", *frame.fields).alias("__text"))
    context = F.concat_ws(" ", *(frame.value(f) for f in ("command", "message", "raw_log") if f in frame.fields))
    named = [F.struct(F.lit("username").alias("kind"), frame.value("username").alias("value"))] if "username" in frame.fields else []
    if "process_name" in frame.fields:
        named.append(F.struct(F.lit("process").alias("kind"), F.when(starts_others(context), frame.value("process_name")).otherwise("").alias("value")))
    found = extract(text, "pos", "__text")
    if not named:
        return found
    rows = frame.df.select(F.col("pos").alias("id"), F.explode(F.array(*named)).alias("i"))
    return found.unionByName(rows.select("id", "i.kind", "i.value").where("value <> ''"))
