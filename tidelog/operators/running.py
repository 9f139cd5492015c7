"""Positions and running sums over whole tables, without a window over all rows or over a whole key.

Rows are dealt out by ranges of the order and sorted there; each part's total is carried over to the parts after it. There
are as many totals as shuffle partitions, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written

#: A part's number stands above these bits of ``monotonically_increasing_id``, a row's place in the part below.
BITS = 33


def _in_order(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows with ``_part`` and ``_at``, the place in it. Ranges are sampled and sorted in two runs, so ``df`` should be cheap to compute."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    return kept.select(*df.columns, F.shiftright("_id", BITS).alias("_part"), F.col("_id").bitwiseAND((1 << BITS) - 1).alias("_at"))


def _carried(parts: DataFrame, names: list[str]) -> DataFrame:
    """Of a row of totals for each part: the sums of all totals before. One row for each part, so this is small whatever the data."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names)))


def positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """The rows with their place in the order, from 0. Equal rows of the order stand in any order; where that matters, end it with a unique column."""
    rows = _in_order(df, order)
    before = _carried(rows.groupBy("_part").agg(F.count("*").alias("rows")), ["rows"])
    return rows.join(before, "_part").select(*df.columns, (F.col("_before_rows") + F.col("_at")).alias(name))


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """The rows with columns by name: the sum of a column (whole numbers, null: 0) over all rows before them in the order."""
    rows = _in_order(df, order)
    of = {name: F.coalesce(F.col(value).cast("long"), F.lit(0)) for name, value in sums.items()}
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(name) for name, c in of.items()))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{name}") for name, c in of.items()))
    return summed.join(_carried(totals, list(sums)), "_part").select(*df.columns, *((F.col(f"_before_{name}") + F.col(f"_in_{name}")).alias(name) for name in sums))


def neighbours(df: DataFrame, order: list[str | Column], value: str) -> DataFrame:
    """The rows with ``before`` and ``after``: the nearest value that is not null at or before, and at or after, the row in the order.

    An as-of join in both directions without a key: however many rows stand at one time, they are dealt out like any others.
    """
    rows = _in_order(df, order)
    inside = Window.partitionBy("_part").orderBy("_at")
    # what follows is read backwards: a frame that ends behind the last row would be gone through anew for each row
    to_here, from_here = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (inside, Window.partitionBy("_part").orderBy(F.desc("_at"))))
    ends = rows.where(F.col(value).isNotNull()).groupBy("_part").agg(F.min_by(value, "_at").alias("first"), F.max_by(value, "_at").alias("last"))
    # every part with what the parts before and after it end and begin with: one row for each part
    parts = rows.select("_part").distinct().join(ends, "_part", "left")
    earlier, later = (Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.col("_part"), F.desc("_part")))
    carried = F.broadcast(parts.select("_part", F.last("last", True).over(earlier).alias("_last"), F.last("first", True).over(later).alias("_first")))
    near = rows.select("*", F.last(value, True).over(to_here).alias("_before"), F.last(value, True).over(from_here).alias("_after"))
    return near.join(carried, "_part").select(*df.columns, F.coalesce("_before", "_last").alias("before"), F.coalesce("_after", "_first").alias("after"))
