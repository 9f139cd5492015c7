"""Groups that share much: weighted overlap of at least so much, without listing pairs that can't reach it.

Values are ordered by how rare they are. Groups whose common values alone make up ``least`` points are compared block by block: their common values are
the columns of a 0/1 matrix, a product of two blocks gives the points of all their pairs, and what pairs share of rarer values is added. All other pairs must
share a rare value: what a group may leave out of its rarest values without losing ``least`` points is not looked up, and each pair that meets is then counted
over all values. Groups with equal values are one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written

#: Values that at least one in so many classes has are common, and at most so many of them are columns of the matrix.
COMMON, COLUMNS = 64, 4096
#: Classes of a block: two blocks are compared by one task, which holds a number for each of their pairs.
BLOCK = 2048
#: Tasks at most that compare blocks, blocks into which smaller numbers of classes are cut, and pairs that a task sends at once.
TASKS, PARTS, SENT = 1000, 8, 1 << 16


def classes(sets: DataFrame) -> DataFrame:
    """group, class: the least group of those whose values (group, field, value; repeats count once) are the same.

    Sets are compared by two sums of independent hashes and their size, which partial aggregates add up; no group's values are collected.
    """
    distinct = sets.select("group", "field", "value").distinct()
    mark = lambda seed: F.sum(F.xxhash64("field", "value", F.lit(seed)).cast("decimal(38,0)"))
    prints = distinct.groupBy("group").agg(F.count("*").alias("n"), mark(1).alias("p"), mark(2).alias("q"))
    least = prints.groupBy("n", "p", "q").agg(F.min("group").alias("class"))
    return prints.join(least, ["n", "p", "q"]).select("group", "class")


def multiplied(dealt: pa.Table, rarer: pa.Table, columns: list[int], least: int) -> pa.Table:
    """Pairs (a, b, n_shared, score) between two blocks, or within one. ``dealt``: group, bits (of the matrix), block, first and second; ``rarer``: a, b, n and
    w, what pairs share of other values. ``columns``: the points of the matrix's columns."""
    if not dealt.num_rows:
        return pa.table({"a": dealt.column("group"), "b": dealt.column("group"), "n_shared": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    block, first, second = dealt.column("block").to_numpy(), dealt.column("first")[0].as_py(), dealt.column("second")[0].as_py()
    bits = np.stack([np.frombuffer(x, np.uint8) for x in dealt.column("bits").to_pylist()])
    base = len(columns) + 1  # a sum holds the points, and below them how many columns are shared
    kind = np.float32 if base * (sum(columns) + 1) < 1 << 24 else np.float64
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    rows = lambda at: np.unpackbits(bits[at], axis=1, count=len(columns)).astype(kind)
    sums = (rows(left) * (np.array(columns, kind) * base + 1)) @ rows(right).T
    names = dealt.column("group").combine_chunks()
    n = w = None
    if rarer.num_rows:
        n, w = np.divmod(sums.astype(np.int64), base)[::-1]
        a, b = rarer.column("a"), rarer.column("b")
        place = lambda of, at: pc.fill_null(pc.index_in(of, value_set=names.take(pa.array(at))), -1).to_numpy()
        for row, column in ((place(a, left), place(b, right)), (place(b, left), place(a, right))):  # pairs are distinct, so no place comes twice
            meet = (row >= 0) & (column >= 0)
            n[row[meet], column[meet]] += rarer.column("n").to_numpy()[meet]
            w[row[meet], column[meet]] += rarer.column("w").to_numpy()[meet]
    found = w >= least if w is not None else sums >= least * base
    x, y = np.nonzero(np.triu(found, 1) if first == second else found)
    n, w = (n[x, y], w[x, y]) if w is not None else np.divmod(sums[x, y].astype(np.int64), base)[::-1]
    out = pa.table({"a": names.take(pa.array(left[x])), "b": names.take(pa.array(right[y])), "n_shared": pa.array(n, pa.int64()), "score": pa.array(w, pa.int64())})
    return pa.Table.from_batches(out.to_batches(max_chunksize=SENT), out.schema)


def compared(mine: DataFrame, common: list, heavy: DataFrame, n_heavy: int, rarer: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, n_shared, score) of the groups of ``heavy`` by products of blocks. ``mine``: group, field, value, w; ``rarer``: the rows of ``mine`` whose
    values are no columns of the matrix, but more than one group has."""
    spark = mine.sparkSession
    places = F.broadcast(spark.createDataFrame([(r.field, r.value, k) for k, r in enumerate(common)], "field string, value string, k int"))  # at most COLUMNS rows
    points = [r.w for r in common]
    width = -(-len(points) // 8)

    def packed(batches):
        for batch in batches:
            lists = batch.column("ks")
            bits = np.zeros((batch.num_rows, width * 8), bool)
            bits[np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["group", "bits"])

    kind = mine.schema["group"].dataType.simpleString()
    blocks = max(math.ceil(n_heavy / BLOCK), min(PARTS, math.ceil(n_heavy * PARTS / BLOCK)))
    pairs = blocks * (blocks + 1) // 2
    tasks = min(pairs, TASKS)
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    rows = mine.join(places, ["field", "value"]).join(heavy, "group", "left_semi").groupBy("group").agg(F.collect_list("k").alias("ks"))
    rows = rows.mapInArrow(packed, f"group {kind}, bits binary").withColumn("block", block_of("group"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.select("group", "bits", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).repartition(tasks, "first", "second")
    rest = rarer.join(heavy, "group", "left_semi")
    rest = rest.withColumnRenamed("group", "a").join(rest.select(F.col("group").alias("b"), "field", "value"), ["field", "value"]).where("a < b")
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("w"))
    rest = rest.select("*", F.least(block_of("a"), block_of("b")).alias("first"), F.greatest(block_of("a"), block_of("b")).alias("second")).repartition(tasks, "first", "second")
    out = rows.groupBy("first", "second").cogroup(rest.groupBy("first", "second")).applyInArrow(lambda x, y: multiplied(x, y, points, least), f"a {kind}, b {kind}, n_shared long, score long")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_shared", "score")


def similar(sets: DataFrame, weights: dict[str, int], least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, n_shared, score) with at least ``least`` points, and the members (group, class) of all classes.

    A value that two classes share gives the points of its field; fields without points are passed over. Members of one class share all they have.
    ``least`` must be above 0. Groups whose values' points add up to less can have no partner and are in no pair.
    """
    if least <= 0 or min(weights.values(), default=1) <= 0:
        raise ValueError("least and weights must be above 0")
    weight = F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(w))))
    known = written(sets.where(F.col("field").isin(list(weights))).select("group", "field", "value").distinct(), "values")
    members = written(classes(known), "members")
    mine = known.join(members.where("group = class").select("group"), "group", "left_semi").withColumn("w", weight[F.col("field")])
    often = written(mine.groupBy("field", "value").agg(F.count("*").alias("often"), F.first("w").alias("w")).where("often > 1"), "often")
    n = members.where("group = class").count()
    order = [F.desc("often"), F.desc("field"), F.desc("value")]
    common = often.where(F.col("often") * COMMON >= n).orderBy(*order).limit(COLUMNS).collect()  # at most COLUMNS rows
    last = F.struct(F.lit(common[-1].often).cast("long").alias("often"), F.lit(common[-1].field).alias("field"), F.lit(common[-1].value).alias("value")) if common else None
    is_common = F.struct("often", "field", "value") >= last if common else F.lit(False)
    # the points of a group's values from the commonest up to this one: below ``least`` they can't make a pair on their own
    up = Window.partitionBy("group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = mine.join(often.drop("w"), ["field", "value"]).withColumn("common", is_common)
    ranked = written(ranked.withColumn("upto", F.sum("w").over(up)), "ranked")
    heavy = written(ranked.where("common").groupBy("group").agg(F.sum("w").alias("points")).where(F.col("points") >= least).select("group"), "heavy")
    n_heavy = heavy.count()
    rarer = ranked.where("not common").select("group", "field", "value", "w")
    rare = ranked.where((F.col("upto") >= least) & ~F.col("common")).select("group", "field", "value").join(heavy.withColumn("heavy", F.lit(True)), "group", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    a, b = rare.withColumnsRenamed({"group": "a", "heavy": "a_heavy"}), rare.withColumnsRenamed({"group": "b", "heavy": "b_heavy"})
    met = written(a.join(b, ["field", "value"]).where("a < b AND NOT (a_heavy AND b_heavy)").select("a", "b").distinct(), "met")
    values = ranked.select("group", "field", "value", "w")
    left = met.join(values.withColumnRenamed("group", "a"), "a")
    both = left.join(values.select(F.col("group").alias("b"), "field", "value"), ["b", "field", "value"], "left_semi")
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sum("w").cast("long").alias("score")).where(F.col("score") >= least)
    if n_heavy > 1:
        pairs = pairs.unionByName(compared(values, common, heavy, n_heavy, rarer, least))
    return pairs, members


def overlaps(sets: DataFrame, weights: dict[str, int]) -> DataFrame:
    """All pairs of groups that share a value: a, b, n_shared, score. ``sets``: group, field, value; a value weighs as its field says, counted once. Equal groups
    are pairs too: there are no classes here.

    Groups with common values are compared by products of blocks, so nothing is joined on a value that many have: a task holds two blocks, whatever the number of pairs.
    """
    if min(weights.values(), default=1) <= 0:
        raise ValueError("weights must be above 0")
    weight = F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(w))))
    mine = sets.where(F.col("field").isin(list(weights)) & F.col("group").isNotNull() & F.col("value").isNotNull()).select("group", "field", "value").distinct()
    mine = written(mine.withColumn("w", weight[F.col("field")]), "values")
    n = mine.select("group").distinct().count()
    often = written(mine.groupBy("field", "value").agg(F.count("*").alias("often"), F.first("w").alias("w")).where("often > 1"), "often")
    common = often.where(F.col("often") * COMMON >= n).orderBy(F.desc("often"), "field", "value").limit(COLUMNS).collect()  # at most COLUMNS rows
    columns = F.broadcast(mine.sparkSession.createDataFrame([(r.field, r.value) for r in common], "field string, value string"))
    heavy = written(mine.join(columns, ["field", "value"], "left_semi").select("group").distinct(), "heavy")
    rarer = mine.join(often.select("field", "value").join(columns, ["field", "value"], "left_anti"), ["field", "value"], "left_semi")
    # a group without common values has no row in the matrix, and shares rare values only
    marked = rarer.join(heavy.withColumn("heavy", F.lit(True)), "group", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    a, b = marked.withColumnsRenamed({"group": "a", "heavy": "a_heavy"}), marked.drop("w").withColumnsRenamed({"group": "b", "heavy": "b_heavy"})
    met = a.join(b, ["field", "value"]).where("a < b AND NOT (a_heavy AND b_heavy)")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sum("w").cast("long").alias("score"))
    n_heavy = heavy.count()
    return pairs.unionByName(compared(mine, common, heavy, n_heavy, rarer, 1)) if n_heavy > 1 else pairs
