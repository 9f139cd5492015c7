"""Mixes sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a budget of words. Whole epochs of it come first; what is left of the budget goes to its documents in the
order of exponential keys, -ln(u) / weight, least first, so that a document of twice the weight is as likely to be the first
as two. Sizes are summed over that order and the document in which the budget ends is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import positions, running_sums
from ..stored import written

WORD = r"[^\x20\x09-\x0D]+"
#: Shares of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's words, as a share of all, and how often a source may be read.
TOTAL, EPOCHS = 1.5, 2
SIGNS = "0123456789#*$%&|<>{}[]=+_~^/\\"
#: The least weight of a document, and the words that halve a short one's.
LEAST, SHORT = 0.05, 50


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight, 0.05 to 1: the share of its characters that are neither digits nor signs, less for short texts."""
    plain = F.try_divide(F.length(F.translate(text, SIGNS, "")), F.length(text))
    return F.coalesce(F.greatest(F.lit(LEAST), plain * (size / (size + SHORT))), F.lit(LEAST))


def uniform(*of: Column) -> Column:
    """A number inside (0, 1) that depends on the values alone, so that reruns agree."""
    digits = F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in of)), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def budgets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target and start, the words of all sources before, for sources (source, source_size), of which each row is another one.

    Targets share ``total`` times all words by weight; no source gets more than ``epochs`` times its size, what is over is shared out again. That ends
    where every source that is not full has its weight times one level: with sources in the order in which they fill up, the level is the highest of
    (words not yet dealt) / (weights not yet full) on the way. Weights go by the order of ``source``.
    """
    rank = F.array(*map(F.lit, weights))[F.pmod("rank", F.lit(len(weights))).cast("int")]
    rows = positions(sources, ["source"], "rank").withColumn("weight", rank.cast("long")).withColumn("most", F.col("source_size") * epochs)
    rows = written(running_sums(rows, ["source"], {"start": "source_size"}), "sources")
    words, shares = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filling = running_sums(rows, [F.col("most") / F.col("weight"), F.col("source")], {"full": "most", "gone": "weight"})
    level = filling.agg(F.max((F.lit(total * words) - F.col("full")) / (F.lit(shares) - F.col("gone")))).first()[0] or 0.0
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"), "start")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, weight: Column | None = None, seed: int = 0, whole: bool = False,
) -> DataFrame:
    """id, size, source_size, target, taken and key of each row: the words of its text, of its source, those that the mix should and does take.

    Sources go by code point, null last and a source like any other; a null text has no words. ``weight`` scales the keys, by default ``quality_weight``; it must be
    above 0, what is not counts as LEAST. Each source's ``taken`` add up to its target, to a word; with ``whole`` no document is cut and the last one is taken
    if half of it fits. Repeated rows and ids are documents of their own. An empty table gives no rows, other columns are left out.
    """
    # null comes after all names
    source = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit(","))
    sized = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.col(text_col).alias("text"), (weight if weight is not None else F.lit(None).cast("double")).alias("given"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    scale = F.when(F.col("given") > 0, F.col("given")).otherwise(LEAST) if weight is not None else quality_weight(F.col("text"), F.col("size"))
    lean = written(sized.select("id", "source", "size", (-F.ln(uniform(F.lit(seed), F.col("id"), F.col("text"))) / scale).alias("key")), "sizes")
    sources = budgets(lean.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, epochs)
    rows = running_sums(lean, ["source", "key", "id", "size"], {"before": "size"}).join(sources, "source")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("rounds", rounds).withColumn("rest", F.floor(F.col("target") - F.col("rounds") * F.col("source_size") + 0.5) - (F.col("before") - F.col("start")))
    last = F.when(F.col("rest") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least("size", "rest"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("rounds") * F.col("size") + last).cast("long").alias("taken"), "key")
