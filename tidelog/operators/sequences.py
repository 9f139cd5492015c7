"""Orders and sequences by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..logframe import LogFrame

def _failed(frame: LogFrame) -> Column:
    return frame.value("action") == "failed_login"


def _good(frame: LogFrame) -> Column:
    return frame.value("action").isin("successful_login", "login_success", "success")


def success_after_failures(frame: LogFrame, least: int = 3, span: int = 3600) -> DataFrame:
    """For each address the first success after at least ``least`` failures: source_ip, pos, n_failures before it, last_failure (the pos of the last one).

    Failures are counted within spans of ``span`` seconds, and the counts of the spans before are added, so no task holds all rows of a busy address.
    """
    rows = frame.df.where((frame.value("source_ip") != "") & F.col("ts").isNotNull()).select("source_ip", "pos", F.unix_micros("ts").alias("us"), _failed(frame).alias("failed"), _good(frame).alias("good")).where("failed or good")
    rows = rows.withColumn("span", F.floor(F.col("us") / (span * 1_000_000)))
    at = F.when(F.col("failed"), F.struct("us", "pos"))
    spans = rows.groupBy("source_ip", "span").agg(F.count_if("failed").alias("n"), F.max(at).alias("last"))
    earlier = Window.partitionBy("source_ip").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("source_ip", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.last("last", ignorenulls=True).over(earlier).alias("last0"))
    before = Window.partitionBy("source_ip", "span").orderBy("us", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"n": F.coalesce(F.sum(F.col("failed").cast("long")).over(before), F.lit(0)), "last": F.last(at, ignorenulls=True).over(before)})
    both = rows.where("good").join(spans, ["source_ip", "span"]).withColumn("total", F.col("n") + F.col("n0")).where(F.col("total") >= least)
    first = both.groupBy("source_ip").agg(F.min(F.struct("us", "pos", "total", F.coalesce("last", "last0").alias("last"))).alias("f"))
    return first.select("source_ip", "f.pos", F.col("f.total").alias("n_failures"), F.col("f.last.pos").alias("last_failure"))


def auth_chains(frame: LogFrame, seconds: int = 900) -> DataFrame:
    """Failures that a success of the same user follows within a time: failed (pos), success (pos), username, micros between; the next success counts.

    Users are cut into spans of that time and successes also stand in the span before their own, so a busy user is dealt out over many tasks.
    """
    width = seconds * 1_000_000
    rows = frame.df.where("ts is not null").select("username", "ts", "pos", F.unix_micros("ts").alias("us"), _failed(frame).alias("failed"), _good(frame).alias("good")).where("failed or good")
    span = F.floor(F.col("us") / width)
    rows = rows.withColumn("span", F.explode(F.when(F.col("good"), F.array(span - 1, span)).otherwise(F.array(span))))
    # read backwards: a frame that ends behind the last row would be gone through anew for each row
    after = Window.partitionBy("username", "span").orderBy(F.desc("us"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(F.col("good"), F.struct("pos", "us")), ignorenulls=True).over(after))
    gap = F.col("next.us") - F.col("us")
    return rows.where(F.col("failed") & (gap <= width)).select(F.col("pos").alias("failed"), F.col("next.pos").alias("success"), "username", gap.alias("micros"))


def representatives(scored: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group of equal keys."""
    return scored.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def consecutive_runs(ids: DataFrame, group: str, number: str, block: int = 100_000) -> DataFrame:
    """group, first, last, n: runs of successive numbers, by the difference of a number and its rank. Nulls are passed over.

    Numbers are cut into blocks, so a group with very many of them is dealt out; only runs that touch a block's border are put together over the group.
    """
    numbers = ids.select(group, number).where(F.col(number).isNotNull()).distinct().withColumn("__block", F.floor(F.col(number) / block))
    rank = F.row_number().over(Window.partitionBy(group, "__block").orderBy(number))
    parts = numbers.withColumn("__island", F.col(number) - rank).groupBy(group, "__block", "__island").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    border = (F.col("first") % block == 0) | (F.col("last") % block == block - 1)
    by_first = Window.partitionBy(group).orderBy("first")
    edges = parts.where(border).withColumn("__new", (F.col("first") != F.coalesce(F.lag("last").over(by_first), F.col("first")) + 1).cast("int"))
    edges = edges.withColumn("__run", F.sum("__new").over(by_first)).groupBy(group, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return parts.where(~border).select(group, "first", "last").unionByName(edges.select(group, "first", "last")).withColumn("n", F.col("last") - F.col("first") + 1)


def steps(frame: LogFrame, field: str = "username", span: int = 3600) -> DataFrame:
    """Each row's next of the same entity: pos, next_pos, micros between.

    Entities are cut into spans of ``span`` seconds; the last row of a span meets the first one of the entity's next span that has rows.
    """
    entity = F.col(frame.require(field)).alias("entity")
    rows = frame.df.where("ts is not null").select(entity, "pos", F.unix_micros("ts").alias("us")).withColumn("span", F.floor(F.col("us") / (span * 1_000_000)))
    w = Window.partitionBy("entity", "span").orderBy("us", "pos")
    inner = rows.select("pos", "us", F.lead(F.struct("us", "pos")).over(w).alias("next"))
    at = F.struct("us", "pos")
    ends = rows.groupBy("entity", "span").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    outer = ends.select("last.pos", "last.us", F.lead("first").over(Window.partitionBy("entity").orderBy("span")).alias("next"))
    return inner.unionByName(outer).where("next is not null").select("pos", F.col("next.pos").alias("next_pos"), (F.col("next.us") - F.col("us")).alias("micros"))


def timeline(frame: LogFrame, condition: Column, limit: int = 100) -> DataFrame:
    """The first rows of a condition by time; rows without a time come first."""
    return frame.df.where(condition).orderBy(F.coalesce("ts", F.lit(0).cast("timestamp")), "pos").limit(limit)


def first_and_last(frame: LogFrame, condition: Column) -> DataFrame:
    """The pos of the first and of the last row of a condition."""
    at = F.struct("ts", "pos")
    return frame.df.where(condition & F.col("ts").isNotNull()).agg(F.min_by("pos", at).alias("first"), F.max_by("pos", at).alias("last"))


def sessions(frame: LogFrame, gap: int = 1800, field: str = "username") -> DataFrame:
    """Sessions of an entity, cut where nothing happens for longer than ``gap`` seconds: entity, session (counted from 0), n_events, first, last (micros).

    Rows are cut into spans of 24 gaps and sessions are made in each; what is put together over an entity are these pieces, of which a gap of time holds two at most.
    """
    micros = gap * 1_000_000
    rows = frame.df.where("ts is not null").select(frame.value(field).alias("entity"), F.unix_micros("ts").alias("us")).groupBy("entity", "us").agg(F.count("*").alias("n"))
    rows = rows.withColumn("span", F.floor(F.col("us") / (24 * micros)))
    w = Window.partitionBy("entity", "span").orderBy("us")
    rows = rows.withColumn("cut", F.coalesce((F.col("us") - F.lag("us").over(w) > micros).cast("int"), F.lit(0))).withColumn("piece", F.sum("cut").over(w))
    pieces = rows.groupBy("entity", "span", "piece").agg(F.sum("n").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))
    every = Window.partitionBy("entity").orderBy("first")
    pieces = pieces.withColumn("cut", F.coalesce((F.col("first") - F.lag("last").over(every) > micros).cast("long"), F.lit(0))).withColumn("session", F.sum("cut").over(every))
    return pieces.groupBy("entity", "session").agg(F.sum("n").alias("n_events"), F.min("first").alias("first"), F.max("last").alias("last"))
