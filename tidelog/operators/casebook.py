"""What the evidence of many cases amounts to: one assessment, its findings with their evidence, what stays open, and what to do next.

Everything is computed for all cases at once. Evidence has case_id, evidence_id and a log's columns. Lists that could grow with a case are tables
of their own (``names``, ``support``), never one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm

#: Types of records of logins and of programs that ran, and how a text tells of failed attempts.
LOGINS, RUNS = ("user_auth",), ("execve", "process_create", "syscall")
TOLD = [r"(?i)\((\d{1,9}) attempts?\)", r"(?i)\bat least (\d{1,9}) failed attempts?\b", r"(?i)\b(\d{1,9}) failed attempts?\b"]
ENTITIES = ["source_ip", "username", "process_name"]


def _value(evidence: DataFrame, name: str) -> Column:
    return norm(name) if name in evidence.columns else F.lit("")


def _marked(evidence: DataFrame) -> DataFrame:
    """case_id, evidence_id, what each piece of evidence is, the attempts that it tells of (null if it doesn't), and its entities."""
    e = {n: _value(evidence, n) for n in ("action", "event_type", "message", "command", *ENTITIES)}
    login = e["event_type"].isin(*LOGINS) | e["action"].isin("failed_login", "successful_login")
    failed = (e["action"] == "failed_login") | (e["event_type"].isin(*LOGINS) & (e["message"].contains("res=failed") | e["message"].contains("failed authentication")))
    told = F.array_max(F.concat(*(F.transform(F.regexp_extract_all(e["message"], F.lit(p), F.lit(1)), lambda x: x.cast("long")) for p in TOLD)))
    ran = e["event_type"].isin(*RUNS) | (e["command"] != "")
    return evidence.select("case_id", "evidence_id", failed.alias("failed"), login.alias("login"), ran.alias("ran"), told.alias("told"), *(e[n].alias(n) for n in ENTITIES))


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), F.count_if("login").alias("n_logins"), F.count_if("ran").alias("n_runs"), F.max("told").alias("_told"),
        F.count_if(F.col("ran") & (F.col("username") == "")).alias("n_unattributed"), F.count_if(F.col("login") & (F.col("source_ip") == "")).alias("n_unsourced"),
        F.countDistinct(F.nullif("source_ip", F.lit(""))).alias("n_ips"), F.countDistinct(F.nullif("username", F.lit(""))).alias("n_users"),
    ).withColumn("attempts", F.coalesce("_told", "n_failed")).drop("_told")


def shared(evidence: DataFrame) -> DataFrame:
    """case_id, field, value, n: entities that several pieces of evidence of a case have, as classes and never as pairs."""
    rows = evidence.select("case_id", *(_value(evidence, f).alias(f) for f in ENTITIES))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ENTITIES))
    return rows.select("case_id", F.explode(pairs).alias("p")).where("p.value <> ''").groupBy("case_id", "p.field", "p.value").agg(F.count("*").alias("n")).where("n > 1")


def names(evidence: DataFrame) -> DataFrame:
    """case_id, field, value: the distinct users, addresses and processes of each case."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), _value(evidence, f).alias("value")) for f in ENTITIES))
    return evidence.select("case_id", F.explode(pairs).alias("p")).where("p.value <> ''").select("case_id", "p.field", "p.value").distinct()


def _every(cases: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """One row for each case with its numbers; ``cases`` (case_id) may name some without evidence."""
    links = shared(evidence).groupBy("case_id").agg(F.count("*").alias("n_shared"))
    numbers = _numbers(_marked(evidence)).join(links, "case_id", "left")
    rows = numbers if cases is None else cases.select("case_id").distinct().join(numbers, "case_id", "left")
    return rows.na.fill(0)


def assess(evidence: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """case_id, n, n_failed, attempts, n_logins, n_runs, n_users, n_ips, n_shared, summary. ``attempts`` is the most that one text tells of ("174 attempts"), else the failures;
    two pieces of evidence can tell of more than two attempts, so both numbers are given."""
    c = F.col
    summary = (
        F.when((c("n_failed") > 1) & (c("attempts") > c("n_failed")), F.format_string("Repeated authentication failures; the evidence tells of at least %d attempts.", "attempts"))
        .when(c("n_failed") > 1, "Repeated authentication failures.")
        .when(c("n_failed") == 1, "An authentication failure.")
        .when((c("n_logins") > 0) & (c("n_runs") > 0), "Authentication and commands in one case.")
        .when(c("n_runs") > 0, "Commands.")
        .when(c("n") > 0, "Activity for review.")
        .otherwise("No evidence is linked.")
    )
    return _every(cases, evidence).select("case_id", "n", "n_failed", "attempts", "n_logins", "n_runs", "n_users", "n_ips", "n_shared", summary.alias("summary"))


def _told(rows: DataFrame, options: list[tuple[Column, Column | str, Column | str]], first: str, second: str) -> DataFrame:
    """case_id, place (from 1) and two columns of those options whose test holds."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    held = F.array_compact(F.array(*(F.when(test, F.struct(as_column(a).alias(first), as_column(b).alias(second))) for test, a, b in options)))
    return rows.select("case_id", F.posexplode(held).alias("place", "x")).select("case_id", (F.col("place") + 1).alias("place"), "x.*")


def findings(evidence: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """case_id, finding (F-001, ... by place), classification, confidence, n_evidence: what is observed, what hangs together, and the limit that holds for every case."""
    rows, c = _every(cases, evidence), F.col
    kinds = [(c("n_failed") > 0, "OBSERVED", c("n_failed")), (c("n_shared") > 0, "CORRELATION", c("n_shared")), (F.lit(True), "LIMITATION", c("n"))]
    out = _told(rows, kinds, "classification", "n_evidence")
    confidence = F.when(c("classification") == "CORRELATION", "MEDIUM").otherwise("HIGH")
    return out.select("case_id", F.format_string("F-%03d", "place").alias("finding"), "classification", confidence.alias("confidence"), "n_evidence")


def support(evidence: DataFrame) -> DataFrame:
    """case_id, classification, evidence_id: the evidence behind each finding: failures, pieces that share an entity with another, and all."""
    rows = _marked(evidence)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ENTITIES))
    long = rows.select("case_id", "evidence_id", F.explode(pairs).alias("p")).where("p.value <> ''").select("case_id", "evidence_id", "p.field", "p.value")
    parts = [
        rows.where("failed").select("case_id", F.lit("OBSERVED").alias("classification"), "evidence_id"),
        long.join(shared(evidence), ["case_id", "field", "value"], "left_semi").select("case_id", F.lit("CORRELATION").alias("classification"), "evidence_id").distinct(),
        rows.select("case_id", F.lit("LIMITATION").alias("classification"), "evidence_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def open_points(evidence: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """case_id, place, kind (uncertainty or action), text: what the evidence leaves open, then what to do next."""
    c, every = F.col, F.lit(True)
    return _told(_every(cases, evidence), [
        (c("n_failed") > 0, "uncertainty", "Failed authentication does not prove compromise."),
        (c("n_unattributed") > 0, "uncertainty", "Some commands have no user."),
        (c("n_unsourced") > 0, "uncertainty", "Some authentication has no source."),
        (every, "uncertainty", "The evidence does not prove causation between events."),
        (c("n_shared") > 0, "uncertainty", "What hangs together in time or by name need not be malicious."),
        (every, "uncertainty", "Only evidence that is linked to the case was looked at."),
        (c("n_ips") > 0, "action", "Find out whether the sources are authorised."),
        (c("n_logins") > 0, "action", "Look at the logins around, failed and successful."),
        (c("n_runs") > 0, "action", "Look at the commands and at what started them."),
        (every, "action", "Keep evidence and notes before the status changes."),
    ], "kind", "text")


def explain(findings_: DataFrame, evidence: DataFrame, related: DataFrame) -> DataFrame:
    """The findings (finding_id, title, confidence, interpretation; texts may be null) with facts as they are, n_evidence, n_related and limits: no evidence, nothing related, no confidence.

    evidence and related: finding_id and evidence_id, or text; empty ones and repeats don't count. Nothing of a finding is raised or made up: without a confidence it is "Not stated".
    """
    counted = lambda df, c, name: df.where(F.trim(F.coalesce(c, F.lit(""))) != "").groupBy("finding_id").agg(F.countDistinct(c).alias(name))
    rows = findings_.join(counted(evidence, "evidence_id", "n_evidence"), "finding_id", "left").join(counted(related, "text", "n_related"), "finding_id", "left").na.fill(0, ["n_evidence", "n_related"])
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    limits = F.array_compact(F.array(F.when(F.col("n_evidence") == 0, "no evidence"), F.when(F.col("n_related") == 0, "nothing related"), F.when(blank("confidence"), "no confidence stated")))
    return rows.select("finding_id", F.when(blank("title"), F.col("finding_id")).otherwise(F.col("title")).alias("title"), F.when(blank("confidence"), "Not stated").otherwise(F.trim("confidence")).alias("confidence"), F.coalesce(F.trim("interpretation"), F.lit("")).alias("interpretation"), "n_evidence", "n_related", F.array_join(limits, "; ").alias("limits"))
