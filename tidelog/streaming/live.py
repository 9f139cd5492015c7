"""Streams of events: histograms and failures that a success follows. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def histogram(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """start, event_type, count of time buckets; events later than ``late`` are left out."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", f"{seconds} seconds"), "event_type").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "event_type", "count")


def auth_chains(events: DataFrame, seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """failed, success, user_id: failures and successes of one user within a time, as a join of two streams whose state the watermarks bound."""
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    failed = rows.where("event_type = 'error'").select(F.col("event_id").alias("failed"), "user_id", F.col("ts").alias("t1")).withWatermark("t1", late)
    good = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("success"), F.col("user_id").alias("u2"), F.col("ts").alias("t2")).withWatermark("t2", late)
    within = (F.col("user_id") == F.col("u2")) & (F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"interval {seconds} seconds"))
    return failed.join(good, within).select("failed", "success", "user_id")
