"""Counts, facets, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_start
from ..logframe import LogFrame


def facet(frame: LogFrame, field: str, k: int = 50) -> DataFrame:
    """The k most frequent values: value, count; ties by value, empty values left out."""
    return frame.df.groupBy(frame.value(field).alias("value")).agg(F.count("*").alias("count")).where("value <> ''").orderBy(F.desc("count"), "value").limit(k)


def facets(frame: LogFrame, fields: list[str], k: int = 10) -> DataFrame:
    """field, rank, value, count: the k most frequent values of several fields in one pass."""
    from pyspark.sql import Window

    counts = frame.long(fields).groupBy("field", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    return counts.select("field", rank.alias("rank"), "value", "count").where(F.col("rank") <= k)


def distinct_count(frame: LogFrame, field: str) -> DataFrame:
    value = frame.value(field)
    return frame.df.agg(F.countDistinct(F.when(value != "", value)).alias("n_values"))


def time_histogram(frame: LogFrame, seconds: int) -> DataFrame:
    """bucket (its start, seconds since 1970) and count; empty buckets are left out."""
    return frame.df.where("ts is not null").groupBy(bucket_start(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("count"))


def time_span(frame: LogFrame) -> DataFrame:
    span = frame.df.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return span.select("first", "last", ((F.unix_micros("last") - F.unix_micros("first")) / 1_000_000).alias("seconds"))


def field_statistics(frame: LogFrame, field: str) -> DataFrame:
    value = frame.value(field)
    stats = frame.df.agg(F.countDistinct(F.when(value != "", value)).alias("n_values"), F.count_if(value != "").alias("occurrences"), F.count("*").alias("n"))
    return stats.select("n_values", "occurrences", F.round(F.col("occurrences") / F.col("n"), 4).alias("ratio"))


def entity_summary(frame: LogFrame, kind: str) -> DataFrame:
    """value, n_rows: rows that hold an entity in any of its fields, each row once."""
    return frame.long(frame.entity(kind)).select("pos", "value").distinct().groupBy("value").agg(F.count("*").alias("n_rows"))


def auth_summary(frame: LogFrame) -> DataFrame:
    action = frame.value("action")
    failed, good = F.count_if(action.contains("fail")), F.count_if(action.contains("success"))
    return frame.df.agg(failed.alias("failed"), good.alias("successful"), (failed + good).alias("total"))


def coverage(frame: LogFrame, condition: Column) -> DataFrame:
    """How much of the log a condition covers, and the level's name."""
    n = frame.df.agg(F.count_if(condition).alias("covered"), F.count("*").alias("total"))
    ratio = F.coalesce(F.col("covered") / F.nullif("total", F.lit(0)), F.lit(0.0))
    level = F.when(ratio >= 0.99, "COMPLETE").when(ratio >= 0.5, "TARGETED").when(ratio > 0, "PARTIAL").otherwise("UNKNOWN")
    return n.select("covered", "total", F.round(ratio, 4).alias("ratio"), level.alias("level"))


def summary(frame: LogFrame) -> DataFrame:
    """Six figures of the log in one pass; distinct values as they stand."""
    raw = lambda f: F.countDistinct(F.when(F.col(f) != "", F.col(f)))
    action = frame.value("action")
    return frame.df.agg(F.count("*").alias("n_events"), raw("source_ip").alias("n_ips"), raw("username").alias("n_users"), raw("event_type").alias("n_types"), F.count_if(action.contains("fail")).alias("n_failed"), F.count_if(frame.value("severity").isin("high", "critical")).alias("n_severe"))


def by_hour(frame: LogFrame) -> DataFrame:
    return frame.df.where("ts is not null").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("count"))


def peak_hour(frame: LogFrame) -> DataFrame:
    """The hour with most events, the lowest on ties."""
    return by_hour(frame).orderBy(F.desc("count"), "hour").limit(1)


def command_statistics(frame: LogFrame) -> DataFrame:
    """process, n_commands, n_distinct for each process that ran commands."""
    rows = frame.df.where(frame.value("command") != "")
    return rows.groupBy(frame.value("process_name").alias("process")).agg(F.count("*").alias("n_commands"), F.countDistinct("command").alias("n_distinct"))


def candidates(frame: LogFrame, k: int = 10) -> DataFrame:
    """The busiest addresses with what they did: source_ip, n_events, n_failed, n_successful, n_users, n_severe."""
    action = frame.value("action")
    out = frame.df.where(frame.value("source_ip") != "").groupBy("source_ip")
    out = out.agg(F.count("*").alias("n_events"), F.count_if(action.contains("fail")).alias("n_failed"), F.count_if(action.contains("success")).alias("n_successful"), F.countDistinct("username").alias("n_users"), F.count_if(frame.value("severity").isin("high", "critical")).alias("n_severe"))
    return out.orderBy(F.desc("n_events"), "source_ip").limit(k)


def dashboard(frame: LogFrame) -> DataFrame:
    """Figures of the security view in one pass: failures, failure rate in percent, addresses that failed, destinations, privileged and web commands."""
    action, command = frame.value("action"), frame.value("command")
    failed, good = F.count_if(action.contains("fail")), F.count_if(action.contains("success"))
    return frame.df.agg(
        failed.alias("n_failed"),
        F.round(100 * failed / F.nullif(failed + good, F.lit(0)), 2).alias("failure_rate"),
        F.countDistinct(F.when(action.contains("fail"), F.col("source_ip"))).alias("n_failing_ips"),
        F.countDistinct("destination_ip").alias("n_destinations"),
        F.count_if(frame.value("process_name").isin("sudo", "su", "pkexec")).alias("n_privileged"),
        F.count_if(command.rlike(r"https?://")).alias("n_web_commands"),
    )


def largest(frame: LogFrame, field: str) -> DataFrame:
    """The greatest numeric value of a field; what is no number is passed over."""
    number = frame.value(field).try_cast("double")
    return frame.df.agg(F.max(F.when(~F.isnan(number), number)).alias("largest"))


def row_hashes(frame: LogFrame) -> DataFrame:
    """pos and the SHA-256 of the row's fields as JSON, nulls as empty strings."""
    return frame.df.select("pos", F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(f), F.lit("")).alias(f) for f in frame.fields))), 256).alias("sha256"))


def manifest(frame: LogFrame, per_part: int = 1000) -> DataFrame:
    """part, n_rows, sha256: a digest over the ordered row hashes of each run of ``per_part`` positions, so that parts are checked on their own."""
    parts = row_hashes(frame).groupBy(F.floor(F.col("pos") / per_part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "sha256"))).alias("rows"))
    return parts.select("part", F.size("rows").cast("long").alias("n_rows"), F.sha2(F.array_join(F.transform("rows", lambda r: r["sha256"]), ","), 256).alias("sha256"))
