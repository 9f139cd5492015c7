"""Claims about a log against the log itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import terms


def counts(claims: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """claim, value, stated, actual, verdict for claims (claim, value, stated) on how many rows have a value in a field. A value that no row has counts 0."""
    real = rows.groupBy(F.lower(F.trim(F.col(field))).alias("__v")).agg(F.count("*").alias("__n"))
    out = claims.join(real, F.lower(F.trim("value")) == F.col("__v"), "left")
    actual = F.coalesce("__n", F.lit(0))
    return out.select("claim", "value", "stated", actual.alias("actual"), F.when(F.col("stated") == actual, "SUPPORTED").otherwise("CONTRADICTED").alias("verdict"))


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim, cited, known: the references [ID] in claims (claim, text), and whether evidence (evidence_id) has them."""
    cited = claims.select("claim", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([A-Z]+-\d+)\]"), F.lit(1)))).alias("cited"))
    known = evidence.select(F.col("evidence_id").alias("cited"), F.lit(True).alias("__k")).distinct()
    return cited.join(known, "cited", "left").select("claim", "cited", F.coalesce("__k", F.lit(False)).alias("known"))


def recover(claims: DataFrame, evidence: DataFrame, keep: int = 4, least: int = 2) -> DataFrame:
    """claim, evidence_id, shared: for claims (claim, text) the evidence (evidence_id, text) that shares most terms, at least ``least`` and at most ``keep`` of them."""
    from pyspark.sql import Window

    a = claims.select("claim", F.explode(terms(F.col("text"))).alias("t"))
    b = evidence.select("evidence_id", F.explode(terms(F.col("text"))).alias("t"))
    shared = a.join(b, "t").groupBy("claim", "evidence_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    rank = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("shared"), "evidence_id"))
    return shared.withColumn("__r", rank).where(F.col("__r") <= keep).drop("__r")


#: Words that make a claim an interpretation, a cause or a conclusion.
CAUSAL, HEDGED, CERTAIN = r"(?i)\b(because|caused|due to|led to|resulted in)\b", r"(?i)\b(may|might|could|possibly|likely|suggests?|appears?)\b", r"(?i)\b(confirmed|proves?|definitely|compromised|breach(ed)?|attacker)\b"


def classify(claims: DataFrame) -> DataFrame:
    """claim, kind of claims (claim, text): COUNT, CAUSAL, HEDGED, CONCLUSION or OBSERVATION."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.when(text.rlike(r"\b\d+ (events?|rows?|failures?|attempts?|logins?)\b"), "COUNT").when(text.rlike(CAUSAL), "CAUSAL").when(text.rlike(HEDGED), "HEDGED").when(text.rlike(CERTAIN), "CONCLUSION").otherwise("OBSERVATION")
    return claims.select("claim", kind.alias("kind"))
