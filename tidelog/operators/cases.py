"""Evidence, cases and the graph of a case as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..logframe import LogFrame
from ..sources.json_logs import numbered
from .sequences import steps

PRIORITY = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
IDENTITY = ["file", "line", "timestamp"]


def add_evidence(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with those rows of ``new`` whose file, line and timestamp it lacks, numbered on as EV-######. Of equal new rows the first by priority stays.

    Numbers follow the order of identities: new rows are dealt into ranges, numbered in each, and the ranges' sizes are added.
    """
    fresh = new.join(store.select(*IDENTITY), IDENTITY, "left_anti").dropDuplicates(IDENTITY)
    last = store.agg(F.coalesce(F.max(F.substring("evidence_id", 4, 12).cast("long")), F.lit(0))).scalar()
    named = numbered(fresh.drop("evidence_id"), IDENTITY).withColumn("evidence_id", F.format_string("EV-%06d", F.col("pos") + 1 + last))
    return store.unionByName(named.select(store.columns))


def update_evidence(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Status, priority and note of the evidence named in ``changes`` (evidence_id and any of them); nulls leave a value as it is."""
    fields = [c for c in changes.columns if c != "evidence_id"]
    new = changes.select("evidence_id", *(F.col(c).alias(f"__{c}") for c in fields))
    return store.join(new, "evidence_id", "left").select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in store.columns))


def find_evidence(store: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    out = store.where(F.col("status") == status) if status else store
    return out.where(F.col("priority") == priority) if priority else out


def link(cases: DataFrame, case_id: str, evidence_ids: list[str]) -> DataFrame:
    """The case with more evidence, each once and in order."""
    new = F.array_union("evidence_ids", F.array(*map(F.lit, evidence_ids)).cast("array<string>"))
    return cases.withColumn("evidence_ids", F.when(F.col("case_id") == case_id, new).otherwise(F.col("evidence_ids")))


def evidence_of(cases: DataFrame, store: DataFrame) -> DataFrame:
    """case_id and the rows of the evidence that cases name."""
    return cases.select("case_id", F.explode("evidence_ids").alias("evidence_id")).join(store, "evidence_id")


def lineage(cases: DataFrame, store: DataFrame) -> DataFrame:
    """case_id, place, evidence_id, known: each reference of a case in order, and whether the store has it."""
    refs = cases.select("case_id", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    return refs.join(store.select("evidence_id", F.lit(True).alias("__k")), "evidence_id", "left").select("case_id", "place", "evidence_id", F.coalesce("__k", F.lit(False)).alias("known"))


def missing(cases: DataFrame, store: DataFrame) -> DataFrame:
    """References to evidence that the store lacks."""
    return cases.select("case_id", F.explode("evidence_ids").alias("evidence_id")).join(store, "evidence_id", "left_anti").select("case_id", "evidence_id")


def case_summary(evidence: DataFrame) -> DataFrame:
    """For each case: n, n_severe, n_users, n_ips, first, last."""
    return evidence.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity").isin("high", "critical")).alias("n_severe"), F.countDistinct("username").alias("n_users"), F.countDistinct("source_ip").alias("n_ips"), F.min("us").alias("first"), F.max("us").alias("last")
    )


def gaps(evidence: DataFrame) -> DataFrame:
    """case_id, gap: what a case lacks for a decision."""
    tests = {
        "no failed authentication": F.count_if(F.col("action") == "failed_login") == 0,
        "no successful authentication": F.count_if(F.col("action") == "successful_login") == 0,
        "no command": F.count_if(F.coalesce(F.col("command"), F.lit("")) != "") == 0,
        "one source only": F.countDistinct("source_ip") < 2,
        "no severe event": F.count_if(F.col("severity").isin("high", "critical")) == 0,
    }
    flags = evidence.groupBy("case_id").agg(*(c.alias(f"g{k}") for k, c in enumerate(tests.values())))
    return flags.select("case_id", F.explode(F.array_compact(F.array(*(F.when(F.col(f"g{k}"), F.lit(name)) for k, name in enumerate(tests))))).alias("gap"))


def decisions(evidence: DataFrame) -> DataFrame:
    """case_id, n_gaps, decision: escalate (severe events and at most one gap), close (no severe event), else investigate."""
    open_gaps = gaps(evidence).groupBy("case_id").agg(F.count("*").alias("n_gaps"), F.max(F.col("gap") == "no severe event").alias("calm"))
    every = evidence.select("case_id").distinct().join(open_gaps, "case_id", "left")
    n, calm = F.coalesce("n_gaps", F.lit(0)), F.coalesce("calm", F.lit(False))
    return every.select("case_id", n.cast("long").alias("n_gaps"), F.when(calm, "close").when(n <= 1, "escalate").otherwise("investigate").alias("decision"))


def graph(frame: LogFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (source, target, type) of the chosen rows (pos) with their users, addresses, processes and next rows."""
    inside = frame.on(frame.df.join(rows.select("pos").distinct(), "pos", "left_semi"))
    kinds = {"username": "user", "source_ip": "ip", "process_name": "process"}
    long = inside.long([f for f in kinds if f in frame.fields])
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("field")]
    event = F.concat(F.lit("event:"), F.col("pos").cast("string"))
    named = long.select(event.alias("source"), F.concat(kind, F.lit(":"), F.col("value")).alias("target"), kind.alias("type"), "value")
    nodes = inside.df.select(event.alias("id"), F.lit("event").alias("type"), F.col("message").alias("label")).unionByName(named.select(F.col("target").alias("id"), "type", F.col("value").alias("label")).distinct())
    follow = steps(inside).select(event.alias("source"), F.concat(F.lit("event:"), F.col("next_pos").cast("string")).alias("target"), F.lit("next").alias("type"))
    return nodes, named.select("source", "target", "type").unionByName(follow)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reattach(rows: DataFrame, store: DataFrame) -> DataFrame:
    """The rows with the evidence_id that file, line and timestamp have in the store; null if none."""
    return rows.join(store.select(*IDENTITY, "evidence_id"), IDENTITY, "left")


def html_report(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """A page with the first rows of each table, for people to read; the tables themselves go to files by Spark's writers."""
    from html import escape

    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        cell = lambda tag, x: f"<{tag}>{escape('' if x is None else str(x))}</{tag}>"
        head = "".join(cell("th", c) for c in df.columns)
        body = "".join(f"<tr>{''.join(cell('td', x) for x in row)}</tr>" for row in df.limit(limit).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"
