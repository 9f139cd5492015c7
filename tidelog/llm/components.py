"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointing


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node (the larger ones, or the others and itself) to the node's least neighbour."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    linked = both.join(least, F.col("a") == F.col("k"))
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): node and root, the least node that it is connected with. Nodes without edges to others are left out.

    Each round is two joins over the edges and is cut off by a checkpoint; rounds grow with the logarithm of the longest path.
    """
    checkpointing(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct().checkpoint()
    state = None
    while True:
        now = _star(_star(now, True), False).checkpoint()
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
