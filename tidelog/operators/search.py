"""Free-text and entity search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..logframe import LogFrame


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def free_text(frame: LogFrame, needle: str, field: str | None = None) -> DataFrame:
    """Rows with the needle in any field, or in one."""
    needle = needle.strip().lower()
    return frame.df.where(_any([frame.value(f).contains(needle) for f in ([field] if field else frame.fields)]))


def row_tokens(frame: LogFrame) -> Column:
    return F.array_distinct(F.flatten(F.array(*(tokens(f) for f in frame.fields))))


def token_search(frame: LogFrame, query: str) -> DataFrame:
    """Rows that hold every token of the query."""
    wanted = [t for t in query.lower().split() if len(t) >= 2]
    held = frame.df.withColumn("__tokens", row_tokens(frame))
    return held.where(reduce(lambda a, b: a & b, [F.array_contains("__tokens", t) for t in wanted], F.lit(True))).drop("__tokens")


def term_rows(frame: LogFrame, term: str) -> DataFrame:
    """Rows with the term as a whole token; if there is none in the log, rows with it inside a token. Terms have two characters at least."""
    term = term.strip().lower()
    if len(term) < 2:
        return frame.df.limit(0)
    held = frame.df.withColumn("__tokens", row_tokens(frame))
    exact = held.agg(F.coalesce(F.max(F.array_contains("__tokens", term)), F.lit(False))).scalar()
    rows = held.where(F.exists("__tokens", lambda t: t.contains(term)))
    return rows.where(~exact | F.array_contains("__tokens", term)).drop("__tokens")


def rows_with_field(frame: LogFrame, term: str) -> DataFrame:
    """Rows with a value in any field whose name contains the term."""
    return frame.df.where(_any([frame.value(f) != "" for f in frame.fields if term.lower() in f.lower()]))


def entity_rows(frame: LogFrame, kind: str, value: str) -> DataFrame:
    """Rows with the value in any field of a kind of entity."""
    return frame.df.where(_any([frame.value(f) == value.strip().lower() for f in frame.entity(kind)]))


def populated_fields(frame: LogFrame) -> DataFrame:
    """field, n_rows with a value, for every field; one pass over the rows."""
    counts = frame.df.agg(*(F.count_if(frame.value(f) != "").alias(f) for f in frame.fields))
    return counts.unpivot([], list(frame.fields), "field", "n_rows")


def resolve_value(frame: LogFrame, value: str) -> DataFrame:
    """Fields that hold the value exactly: field, n_rows, cardinality, fields with few values first."""
    long = frame.long().groupBy("field", "value").agg(F.count("*").alias("n"))
    return long.groupBy("field").agg(F.sum(F.when(F.col("value") == value.strip().lower(), F.col("n"))).alias("n_rows"), F.count("*").alias("cardinality")).where("n_rows > 0").orderBy("cardinality", "field")


def score_rows(frame: LogFrame, query: str, filters: dict[str, str] | None = None, limit: int = 20) -> DataFrame:
    """pos and score of the best rows: one for each query token held, five for the phrase, a quarter for each token inside the text."""
    phrase = query.strip().lower()
    wanted = list(dict.fromkeys(t for t in phrase.split() if len(t) >= 2))
    rows = frame.df.where(reduce(lambda a, b: a & b, [frame.value(f) == v.strip().lower() for f, v in (filters or {}).items()], F.lit(True)))
    rows = rows.select("pos", row_tokens(frame).alias("held"), F.concat_ws(" ", *(frame.value(f) for f in frame.fields)).alias("text"))
    score = F.size(F.array_intersect("held", F.array(*map(F.lit, wanted)).cast("array<string>"))) + F.when(F.col("text").contains(phrase), 5).otherwise(0)
    inside = sum((F.col("text").contains(t).cast("int") for t in wanted), F.lit(0))
    return rows.select("pos", (score + 0.25 * inside).alias("score")).where("score > 0").orderBy(F.desc("score"), "pos").limit(limit)


def page(frame: LogFrame, number: int, size: int = 500) -> DataFrame:
    """The rows of a page by pos, pages counted from 0."""
    return frame.df.orderBy("pos").offset(number * size).limit(size)
