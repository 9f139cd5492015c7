"""Ranking of rows for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import written
from .running import running_sums

K1, B = 1.5, 0.75
#: Endings that are cut from words, longest first.
ENDINGS = ["ing", "ed", "es", "s"]


def stem(word: Column) -> Column:
    """A word of five letters or more without a common ending."""
    out = word
    for ending in reversed(ENDINGS):
        cut = F.substring(word, F.lit(1), F.length(word) - len(ending))
        out = F.when((F.length(word) >= len(ending) + 4) & word.endswith(ending), cut).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Distinct stemmed words of a text, and the parts of words that are put together with dots, slashes, dashes or underscores."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_./:@+-]{2,}"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.split(w, r"[_./:@+-]+")))
    return F.array_distinct(F.transform(F.filter(F.concat(words, parts), lambda w: F.length(w) >= 2), stem))


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms, size: what the scores need of a text."""
    return docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms")).withColumn("size", F.size("terms"))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, limit: int | None = None) -> DataFrame:
    """id and score of the texts that hold a term of the query; a term counts once in a text.

    One pass counts texts, their mean size and the texts with each query term (a row of as many numbers as the query has terms), a second scores.
    """
    spark = docs.sparkSession
    wanted = [r.t for r in spark.range(1).select(F.explode(terms(F.lit(query))).alias("t")).collect()]
    rows = index(docs, id_col, text_col)
    held = [F.array_contains("terms", t) for t in wanted]
    stats = rows.agg(F.struct(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(h).alias(f"df{k}") for k, h in enumerate(held)))).scalar()
    joined = rows.where(F.arrays_overlap("terms", F.array(*map(F.lit, wanted)).cast("array<string>"))).withColumn("s", stats).select("id", "terms", "size", "s.*")
    norm = 1 + K1 * (1 - B + B * F.col("size") / F.col("mean"))
    idf = lambda k: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
    score = sum((F.when(h, idf(k) * (K1 + 1) / norm).otherwise(0.0) for k, h in enumerate(held)), F.lit(0.0))
    out = joined.select("id", score.alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def gram_rows(docs: DataFrame, **kept: Column) -> DataFrame:
    """The columns ``kept`` and ``g``: words and pairs of words of the column ``text``, with repeats. The words stand in a column of their own, so a text is searched once."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    rows = docs.select(*(c.alias(k) for k, c in kept.items()), words.alias("w")).select("*", F.greatest(F.size("w") - 1, F.lit(0)).alias("n"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.col("n")), F.slice("w", F.lit(2), F.col("n")), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.select(*kept, F.concat("w", pairs).alias("g"))


def tfidf(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """id and cosine of the TF-IDF vectors (sublinear counts, smoothed IDF) of text and query. Texts without a common term are left out. Rows of one id are one text.

    A row's terms are made distinct in the row, so counting the texts of each term shuffles one row for a term and task; only texts that hold a term of
    the query are counted term by term and joined with that.
    """
    spark = docs.sparkSession
    asked = gram_rows(spark.range(1).select(F.lit(query).alias("text"))).select(F.explode("g").alias("t")).groupBy("t").agg((1 + F.log(F.count("*"))).alias("q"))
    wanted = [r.t for r in asked.select("t").collect()]  # as many as the query has terms
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    likely = F.exists(F.array(*(F.lit(t) for t in wanted if " " not in t)).cast("array<string>"), lambda t: F.lower("text").contains(t))  # a text with a term holds one of its words
    rows = gram_rows(texts, id=F.col("id"))
    hit = F.arrays_overlap("g", F.array(*map(F.lit, wanted)).cast("array<string>"))
    again = written(docs.groupBy(F.col(id_col).alias("again")).count().where("count > 1").select("again"), "again")
    same = F.col("id").eqNullSafe(F.col("again"))
    repeated = not again.isEmpty()
    once, many = (rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")) if repeated else (rows, None)
    held = once.select(F.explode(F.array_distinct("g")).alias("t"))
    near = gram_rows(texts.where(likely), id=F.col("id"))
    found = (near.join(again, same, "left_anti") if repeated else near).where(hit).select("id", F.explode("g").alias("t"))
    if many is not None:  # counted over their rows
        held = held.unionByName(many.select("id", F.explode("g").alias("t")).distinct().select("t"))
        ids = many.where(hit).select(F.col("id").alias("again")).distinct()
        found = found.unionByName(many.join(ids, same, "left_semi").select("id", F.explode("g").alias("t")))
    counts = written(found.groupBy("id", "t").agg((1 + F.log(F.count("*"))).alias("tf")), "counts")
    n = docs.count()
    needed = counts.select("t").distinct()
    idf = held.groupBy("t").agg(F.count("*").alias("df")).join(needed, "t", "left_semi")
    idf = written(idf.select("t", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    asked = asked.join(idf, "t").select("t", (F.col("q") * F.col("idf")).alias("q"))
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).scalar()
    weights = counts.join(idf, "t").select("id", "t", (F.col("tf") * F.col("idf")).alias("w"))
    both = weights.join(F.broadcast(asked), "t", "left")  # as many rows as the query has terms
    dots = both.groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot is not null")
    return dots.select("id", (F.col("dot") / (F.col("norm") * length)).alias("score"))


def chunks(rows: DataFrame, session: str | None, span: int = 60, run: int = 50) -> DataFrame:
    """pos and chunk: rows of a session, else of a minute, else of ``run`` positions, belong together."""
    named = F.when(F.coalesce(F.col(session), F.lit("")) != "", F.concat(F.lit("s"), F.substring(F.sha1(F.col(session)), 1, 12))) if session else F.lit(None).cast("string")
    minute = F.when(F.col("ts").isNotNull(), F.concat(F.lit("t"), F.floor(F.unix_seconds("ts") / span).cast("string")))
    return rows.select("pos", F.coalesce(named, minute, F.concat(F.lit("p"), F.floor(F.col("pos") / run).cast("string"))).alias("chunk"))


def context(frame, query: str, entities: list[str], hints: dict[str, str], limit: int = 40) -> DataFrame:
    """pos and score of the rows that an answer should rest on: 1 for each query token in the row, 4 for each entity and 6 for each hint (field and value)."""
    text = F.concat_ws(" ", *(frame.value(f) for f in frame.fields))
    words = list(dict.fromkeys(w for w in query.lower().split() if len(w) >= 3))
    score = sum((text.contains(w).cast("int") for w in words), F.lit(0))
    score = score + sum((4 * text.contains(e.lower()).cast("int") for e in entities), F.lit(0))
    score = score + sum((6 * (frame.value(f) == v.strip().lower()).cast("int") for f, v in hints.items()), F.lit(0))
    return frame.df.select("pos", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "pos").limit(limit)


def with_chunks(hits: DataFrame, chunk_of: DataFrame) -> DataFrame:
    """The positions of all rows that share a chunk with a hit (pos)."""
    wanted = chunk_of.join(hits.select("pos"), "pos", "left_semi").select("chunk").distinct()
    return chunk_of.join(wanted, "chunk", "left_semi").select("pos")


def related_terms(frame, hits: DataFrame, fields: list[str], k: int = 5) -> DataFrame:
    """field, value, n: the values that the hits (pos) have most often, to widen a search by."""
    from pyspark.sql import Window

    counts = frame.on(frame.df.join(hits.select("pos"), "pos", "left_semi")).long(fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def within_budget(ranked: DataFrame, text: Column, budget: int, order: list[str | Column], part: int | None = None) -> DataFrame:
    """The rows in their order until their tokens (a quarter of the characters, rounded up) would exceed a budget, with ``tokens`` and ``before``, the tokens of all rows before.

    With ``part`` the rows are also dealt into requests of about that many tokens, numbered from 0. Sums are carried over ranges of the order, so the budget may be of any size.
    """
    sized = written(ranked.withColumn("tokens", F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")), "sized")
    kept = running_sums(sized, order, {"before": "tokens"}).where(F.col("before") + F.col("tokens") <= budget)
    return kept.withColumn("part", F.floor(F.col("before") / part)) if part else kept
