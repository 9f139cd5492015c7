"""Questions in plain English about a log, answered by exact queries over all of it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.iocs import IPV4
from ..logframe import LogFrame
from ..operators import aggregates, sequences
from .filters import predicate

#: What words ask for, and which conditions they name.
INTENTS = [("top", r"\b(top|most|which (user|ip|address|source))\b"), ("first", r"\b(first|earliest)\b"), ("last", r"\b(last|latest)\b(?! \d+ (hour|day|minute))"), ("count", r"\b(how many|count|number of)\b"), ("timeline", r"\b(timeline|when|sequence)\b"), ("list", r"\b(list|show|find|which)\b")]
WORDS = [("action", "failed_login", r"\bfail(ed|ure|ures)?\b"), ("action", "successful_login", r"\bsuccess(ful|es)?\b"), *(("severity", s, rf"\b{s}\b") for s in ("critical", "high", "medium", "low"))]
SUBJECTS = [("username", r"\busers?\b"), ("source_ip", r"\b(ips?|address(es)?|sources?)\b"), ("event_type", r"\btypes?\b")]
UNITS = {"minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Question:
    intent: str
    conditions: list[dict] = field(default_factory=list)
    subject: str = "source_ip"
    last_seconds: int | None = None


def understand(text: str) -> Question:
    """Intent, conditions, what is asked about, and a span of time before the log's end."""
    low = text.lower()
    intent = next((name for name, p in INTENTS if re.search(p, low)), "list")
    out = Question(intent, [{"operation": "EXACT", "field": f, "value": v} for f, v, p in WORDS if re.search(p, low)])
    if ip := re.search(IPV4, text):
        out.conditions.append({"operation": "EXACT", "field": "source_ip", "value": ip[0]})
    if user := re.search(r"\buser (\w+)", low):
        out.conditions.append({"operation": "EXACT", "field": "username", "value": user[1]})
    days = re.findall(r"\b\d{4}-\d\d-\d\d\b", text)
    if days:
        out.conditions.append({"operation": "TIME_RANGE", "start": f"{min(days)}T00:00:00", "end": f"{max(days)}T23:59:59.999999"})
    if span := re.search(r"last (\d+) (minute|hour|day)s?", low):
        out.last_seconds = int(span[1]) * UNITS[span[2]]
    out.subject = next((f for f, p in SUBJECTS if re.search(p, re.sub(r"\buser \w+", "", low))), "source_ip")
    return out


def anchored(text: str) -> tuple[str, str | None]:
    """A question without what follows "after the" (or "after his", ...), and that."""
    found = re.search(r"\bafter (?:the |those |these |his |her |their |its |all )?((?!\d)[^?.!]+)[?.!]*\s*$", text, re.I)
    return (text[: found.start()], found[1].strip()) if found else (text, None)


def named_action(phrase: str, frame: LogFrame) -> str | None:
    """The action whose words begin as most of the phrase's do (four letters, three of short words), ties by name; None if none does. Only distinct actions are looked at."""
    asked = sorted(set(re.findall("[a-z]+", phrase.lower())))
    same = lambda v, w: (F.least(F.length(v), F.lit(min(4, len(w)))) >= 3) & (F.substring(v, 1, min(4, len(w))) == F.substring(F.lit(w), F.lit(1), F.least(F.length(v), F.lit(4))))
    begins = lambda v: sum((same(v, w).cast("int") for w in asked), F.lit(0))
    actions = frame.df.select(frame.value("action").alias("action")).where("action <> ''").distinct()
    words = F.regexp_extract_all("action", F.lit("[a-z]+"), F.lit(0))
    scored = actions.withColumn("score", F.aggregate(F.transform(words, begins), F.lit(0), lambda a, b: a + b)).where("score > 0")
    best = scored.orderBy(F.desc("score"), "action").first()
    return best and best.action


def after(frame: LogFrame, phrase: str, conditions: list[dict]) -> LogFrame:
    """The rows behind the last one that the phrase names, in time and then in place. The question's other conditions hold for that row too, but not those on action and event type.
    Rows without a time are left out; a phrase that names nothing leaves no rows."""
    action = named_action(phrase, frame)
    others = [c for c in conditions if c.get("field") not in ("action", "event_type")]
    wanted = others + ([{"operation": "EXACT", "field": "action", "value": action}] if action else [])
    place = F.struct(F.unix_micros("ts").alias("us"), F.col("pos"))
    if not wanted:
        return frame.on(frame.df.limit(0))
    last = frame.df.where(predicate({"operation": "AND", "conditions": wanted}, frame) & F.col("ts").isNotNull()).agg(F.max(place)).scalar()
    return frame.on(frame.df.where(F.col("ts").isNotNull() & (place > last)))


def answer(text: str, frame: LogFrame, limit: int = 50, earlier: list[str] | None = None) -> DataFrame:
    """Of a question for proof or causes what the log shows on it (``conclusions.observations``); else count, or value and count (top), or first and last, or the rows' pos in order of time (list, timeline: the first ``limit``). "... after the failures" asks for rows behind the last of these.
    "This user" and the like stand for what ``earlier`` questions named."""
    from . import conclusions

    if conclusions.kind(text):
        return conclusions.observations(text, frame, earlier)
    text, phrase = anchored(text)
    question = understand(text)
    question.conditions = conclusions.with_earlier(text, earlier or [])
    condition = predicate({"operation": "AND", "conditions": question.conditions}, frame)
    rows = frame if phrase is None else after(frame, phrase, question.conditions)
    if question.last_seconds is not None:
        end = frame.df.agg(F.max(F.unix_micros("ts"))).scalar()
        rows = rows.on(rows.df.where(F.unix_micros("ts") >= end - question.last_seconds * 1_000_000))
    if question.intent == "count":
        return rows.df.agg(F.count_if(condition).alias("count"))
    if question.intent == "top":
        return aggregates.facet(rows.on(rows.df.where(condition)), question.subject, 10)
    if question.intent in ("first", "last"):
        return sequences.first_and_last(rows, condition).select(F.col(question.intent).alias("pos"))
    return sequences.timeline(rows, condition, limit).select("pos")


def extract_values(text: str, frame: LogFrame, kind: str) -> DataFrame:
    """value and count of the indicators of a kind in the rows that a question selects, over all of them."""
    from ..operators import indicators

    condition = predicate({"operation": "AND", "conditions": understand(text).conditions}, frame)
    found = indicators.from_log(frame.on(frame.df.where(condition))).where(F.col("kind") == kind)
    return found.groupBy("value").agg(F.count("*").alias("count"))


def verified_zero(text: str, frame: LogFrame) -> DataFrame:
    """field, value, n_rows for each condition of a question on its own: which of them makes an answer of zero."""
    conditions = [c for c in understand(text).conditions if "field" in c]
    counts = frame.df.agg(*(F.count_if(predicate(c, frame)).alias(f"n{k}") for k, c in enumerate(conditions)))
    rows = F.array(*(F.struct(F.lit(c["field"]).alias("field"), F.lit(c["value"]).alias("value"), F.col(f"n{k}").alias("n_rows")) for k, c in enumerate(conditions)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def suggest(frame: LogFrame, k: int = 3) -> DataFrame:
    """question: what could be asked about the most frequent users, addresses and actions."""
    top = aggregates.facets(frame, [f for f in ("username", "source_ip", "action") if f in frame.fields], k)
    text = F.when(F.col("field") == "username", F.concat(F.lit("How many failed logins of user "), "value", F.lit(" were there?"))).when(F.col("field") == "source_ip", F.concat(F.lit("Show the timeline of "), "value"))
    return top.select(F.coalesce(text, F.concat(F.lit("Which users have the most events of "), "value", F.lit("?"))).alias("question"))
