"""What a kind of log is looked at by: all its facets and sums in one aggregation over grouping sets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..logframe import LogFrame

#: The facets of each kind of log.
FACETS = {
    "authentication": ["username", "source_ip", "action", "host", "hour"],
    "web": ["source_ip", "url", "action", "severity", "hour"],
    "endpoint": ["process_name", "command", "username", "host", "hour"],
    "network": ["source_ip", "destination_ip", "destination_port", "action", "hour"],
    "mixed": ["event_type", "severity", "action", "source_ip", "username", "hour"],
}


def dashboard(frame: LogFrame, kind: str, n: int = 10) -> DataFrame:
    """facet, value, n_rows, n_failed, n_severe, first and last (pos): the ``n`` most frequent values of each facet of a kind of log, ties by value, and a row of
    facet "all". Fields that the log lacks and empty values are left out; hours are two digits.

    One shuffle over GROUPING SETS: each task sums up its rows for all facets first. The best of each facet are taken in two steps, so a facet of
    very many values is cut down before it meets in one task.
    """
    if kind not in FACETS:
        raise ValueError(f"unknown kind of log {kind!r}; there are {', '.join(FACETS)}")
    facets = [f for f in FACETS[kind] if f == "hour" or f in frame.fields]
    value = lambda f: F.date_format("ts", "HH") if f == "hour" else F.nullif(frame.value(f), F.lit(""))
    failed = frame.value("action").rlike("fail") if "action" in frame.fields else F.lit(False)
    severe = frame.value("severity").isin("high", "critical") if "severity" in frame.fields else F.lit(False)
    rows = frame.df.select("pos", failed.alias("failed"), severe.alias("severe"), *(value(f).alias(f"f{k}") for k, f in enumerate(facets)))
    columns = [F.col(f"f{k}") for k in range(len(facets))]
    sums = rows.groupingSets([[c] for c in columns] + [[]], *columns).agg(
        F.grouping_id().alias("id"), F.count("*").alias("n_rows"), F.count_if("failed").alias("n_failed"), F.count_if("severe").alias("n_severe"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    # in the number of a set all bits but its own facet's are set
    every = (1 << len(facets)) - 1
    names = functools.reduce(lambda when, k: when.when(F.col("id") == every - (1 << (len(facets) - 1 - k)), F.lit(facets[k])), range(len(facets)), F.when(F.col("id") == every, F.lit("all")))
    named = sums.select(names.alias("facet"), F.coalesce(*columns).alias("value"), "n_rows", "n_failed", "n_severe", "first", "last").where("facet = 'all' OR value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n_rows"), "value"))
    return named.withColumn("r", rank).where(F.col("r") <= n).drop("r")
