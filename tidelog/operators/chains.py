"""Evidence as a chain in time, and paths through a case's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..logframe import LogFrame
from ..stored import written
from .running import positions

CONTEXT = ["event_type", "source_ip", "username", "process_name", "action"]
SHARED = ["source_ip", "username", "process_name"]
NEAR_S = 300


def chain(frame: LogFrame, evidence: DataFrame, seconds: int = NEAR_S) -> DataFrame:
    """step (from 1, by time and pos; rows without a time last), pos, context (field=value, joined by "; ") and links to the next step: the fields whose
    value both have, and "temporal" if they are near in time. The last step has none. Links are leads; they say nothing of causes.

    Steps are numbered over ranges of time and the next step is found by its number, so no task sees the whole chain.
    """
    fields = [f for f in CONTEXT if f in frame.fields]
    rows = frame.df.join(evidence.select("pos").distinct(), "pos", "left_semi").select("pos", "us", *(frame.value(f).alias(f) for f in fields))
    steps = written(positions(rows.withColumn("late", F.col("us").isNull()), ["late", "us", "pos"], "n").drop("late"), "steps")
    named = F.array_join(F.array_compact(F.array(*(F.when(F.col(f) != "", F.concat(F.lit(f"{f}="), F.col(f))) for f in fields))), "; ")
    after = steps.select((F.col("n") - 1).alias("n"), F.col("us").alias("_us"), *(F.col(f).alias(f"_{f}") for f in fields if f in SHARED))
    same = [F.when((F.col(f) != "") & (F.col(f) == F.col(f"_{f}")), F.lit(f)) for f in fields if f in SHARED]
    near = F.when(F.col("_us") - F.col("us") <= seconds * 1_000_000, F.lit("temporal"))
    links = F.array_join(F.array_compact(F.array(*same, near)), ",")
    return steps.join(after, "n", "left").select((F.col("n") + 1).alias("step"), "pos", named.alias("context"), links.alias("links"))


def reach(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """node, depth and parent of all nodes that ``most`` steps or fewer over edges (source, target; either way) lead to from starts (node). A start's depth is 0 and its
    parent null; of parents at one depth the least counts. Each round joins only what the one before found and is written."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    both = written(both, "edges")
    new = written(starts.select(F.col("node").cast("string")).where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "reached")
    seen = new
    for depth in range(1, most + 1):
        found = both.join(new.select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        new = written(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"), "reached")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, most: int = 4) -> DataFrame:
    """goal, depth and path (nodes from the start on) of a shortest path to each goal (node) within reach: the one that the parents give, read from its end."""
    tree = written(reach(edges, starts, most), "tree")
    up = tree.select(F.col("node").alias("at"), F.col("parent").alias("above"))
    now = tree.join(goals.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("goal"), "depth", F.col("parent").alias("at"), F.array("node").alias("path"))
    for _ in range(most):
        now = now.join(up, "at", "left").select("goal", "depth", F.col("above").alias("next"), F.when(F.col("at").isNotNull(), F.concat(F.array("at"), F.col("path"))).otherwise(F.col("path")).alias("path")).withColumnRenamed("next", "at")
    return now.select("goal", "depth", "path")
