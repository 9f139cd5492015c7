"""Questions that rows of a log can't settle: whether they prove something, and whether one thing caused another.

Such a question gets no yes or no. It gets what the log does show, counted over all rows: how many events each side of it names, their
outcomes, and the identifiers that both sides share.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..logframe import LogFrame
from ..operators.claims import CONCLUSIONS
from .filters import predicate
from .questions import named_action, understand

#: What ties two events to each other, best first; those that a log lacks are passed over.
TIES = ["session_id", "audit_session", "audit_serial", "request_id", "pid", "ppid", "process_name", "username", "source_ip"]
#: What an earlier question may hand on.
CARRIED = ["source_ip", "destination_ip", "host", "username", "process_name", "domain"]
PROOF = r"\b(?:prov(?:e|es|ed|en)|proof|confirm(?:s|ed)?|establish(?:es|ed)?|demonstrate[sd]?)\b"
_START = r"^\W*(?:(?:did|does|do|was|were|has|have|is|are)\s+)?(?:the\s+)?"
CAUSES = rf"{_START}(?P<first>.+?)\s+(?:caused?|causes|le(?:a)?d to|result(?:ed)? in|trigger(?:ed)?)\s+(?:the\s+)?(?P<second>[^?]+?)\W*$"
CAUSED = rf"{_START}(?P<second>.+?)\s+(?:(?:was |were |been )?(?:caused|triggered) by|due to|because of|the result of)\s+(?:the\s+)?(?P<first>[^?]+?)\W*$"
EARLIER = r"\b(?:this|that|the same) (?:source|ip|address|host|user|account|server|workstation|process|domain)\b"
#: By conclusion: what would have to be recorded for it.
NEEDED = {
    "compromise": "a login that succeeded and what was done in its session",
    "exfiltration": "a transfer with the bytes that were sent and where to",
    "escalation": "a process that went from a user's number to 0",
    "exploitation": "code that ran as a consequence",
    "infection": "a detection of the program or a digest that is known",
    "guessing": "a recorded detection; failures alone are failures",
    "cause": "a session, process or request that both sides share, or a record of one starting the other",
}


def kind(text: str) -> str | None:
    """"cause" or "proof" where a question asks for that, else None."""
    low = text.lower()
    if re.match(CAUSED, low) or re.match(CAUSES, low):
        return "cause"
    return "proof" if re.search(PROOF, low) else None


def sides(text: str) -> tuple[str, str] | None:
    """What is said to be the cause, and what it is said to have caused."""
    found = re.match(CAUSED, text, re.I) or re.match(CAUSES, text, re.I)
    return (found["first"], found["second"]) if found else None


def asked_for(text: str) -> list[str]:
    """The conclusions that a question names; a question about causes names "cause"."""
    low = text.lower()
    named = [fact.split(":")[1] for fact, (said, _) in CONCLUSIONS.items() if fact.startswith("shows:") and re.search(said, low)]
    return ["cause"] if kind(text) == "cause" else named


def statement(text: str) -> str:
    """What the answer says before its rows."""
    if kind(text) == "cause":
        return f"Causation is not established: that one thing follows another doesn't show that it was caused by it. It would take {NEEDED['cause']}."
    named = asked_for(text)
    told = " and ".join(named) or "that"
    return f"These logs do not prove {told}. It would take additional evidence: {'; '.join(NEEDED.get(n, 'a record of it') for n in named) or 'a record of it'}."


def carried(text: str, earlier: list[str], last: int = 4) -> list[dict]:
    """Conditions on what the last questions named (addresses, users, ...), each field and value once, the newest first."""
    out = []
    for question in reversed(earlier[-last:]):
        out += [c for c in understand(question).conditions if c.get("field") in CARRIED and c not in out]
    return out


def with_earlier(text: str, earlier: list[str]) -> list[dict]:
    """The conditions of a question; "this user", "the same source" take what is missing from the earlier questions, for each field the newest value."""
    own = understand(text).conditions
    if not re.search(EARLIER, text, re.I):
        return own
    named = {c.get("field") for c in own}
    for c in carried(text, earlier):
        if c["field"] not in named:
            own, named = [*own, c], named | {c["field"]}
    return own


def side(phrase: str, frame: LogFrame) -> list[dict]:
    """The conditions of one side: what it names and the action that its words begin like."""
    own = [c for c in understand(phrase).conditions if c.get("field") != "action"]
    action = named_action(phrase, frame)
    return own + ([{"operation": "EXACT", "field": "action", "value": action}] if action else [])


def shared(frame: LogFrame, first, second, most: int = 3) -> DataFrame:
    """field, value, n_first, n_second: values of TIES that rows of both sides hold, the ``most`` first by value of each field.

    The log is read once; each value is counted for both sides in one aggregation.
    """
    ties = [c for c in TIES if c in frame.fields]
    both = frame.df.withColumn("_first", F.coalesce(first, F.lit(False))).withColumn("_second", F.coalesce(second, F.lit(False))).where("_first OR _second")
    pairs = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), frame.value(f).alias("value")) for f in ties)), lambda p: p["value"] != "")
    counts = both.select("_first", "_second", F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count_if("_first").alias("n_first"), F.count_if("_second").alias("n_second")).where("n_first > 0 AND n_second > 0")
    rank = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def _row(part: str, field, value, n) -> list:
    as_text = lambda c: c.cast("string") if not isinstance(c, str) else F.lit(c)
    return [F.lit(part).alias("part"), as_text(field).alias("field"), as_text(value).alias("value"), n.cast("long").alias("n")]


def causes(text: str, frame: LogFrame) -> DataFrame:
    """part, field, value, n. "first" and "second": how many events each side names, and by which action; "shared": a value that both hold and the events of both with it.

    Each side has its own conditions, so an address named on one doesn't hold for the other. A side that names nothing in the log leaves it with 0 events.
    """
    phrases = sides(text)
    if phrases is None:
        raise ValueError(f"no cause is asked for: {text!r}")
    both = [side(p, frame) for p in phrases]
    tests = [predicate({"operation": "AND", "conditions": c}, frame) if c else F.lit(False) for c in both]
    names = [next((c["value"] for c in conditions if c.get("field") == "action"), "") for conditions in both]
    counts = frame.df.agg(F.count_if(tests[0]).alias("n0"), F.count_if(tests[1]).alias("n1"))
    told = [counts.select(*_row(part, "action", name, F.col(f"n{k}"))) for k, (part, name) in enumerate(zip(("first", "second"), names, strict=True))]
    found = shared(frame, *tests).select(*_row("shared", F.col("field"), F.col("value"), F.col("n_first") + F.col("n_second")))
    return reduce(DataFrame.unionByName, [*told, found])


def proofs(text: str, frame: LogFrame, earlier: list[str] | None = None, most: int = 6) -> DataFrame:
    """part, field, value, n. "matching": the events that the question's own conditions select; "outcome": their most frequent actions, at most ``most``;
    "earlier": how many events hold what earlier questions named, each on its own. Without conditions no event is said to match."""
    conditions = understand(text).conditions
    test = predicate({"operation": "AND", "conditions": conditions}, frame) if conditions else F.lit(False)
    lenses = [c for c in carried(text, earlier or []) if c["field"] in frame.fields and c["field"] not in {o.get("field") for o in conditions}]
    counts = frame.df.agg(F.count_if(test).alias("n"), *(F.count_if(predicate(c, frame)).alias(f"n{k}") for k, c in enumerate(lenses)))
    told = [counts.select(*_row("matching", "", "", F.col("n")))] + [counts.select(*_row("earlier", c["field"], c["value"], F.col(f"n{k}"))) for k, c in enumerate(lenses)]
    outcomes = frame.df.where(test).groupBy(frame.value("action").alias("value")).agg(F.count("*").alias("n")).where("value <> ''").orderBy(F.desc("n"), "value").limit(most)
    return reduce(DataFrame.unionByName, [*told, outcomes.select(*_row("outcome", "action", F.col("value"), F.col("n")))])


def observations(text: str, frame: LogFrame, earlier: list[str] | None = None) -> DataFrame:
    """What a log shows on a question that it can't settle: see ``causes`` and ``proofs``. ``statement`` says so in words."""
    asked = kind(text)
    if asked is None:
        raise ValueError(f"the question asks for no proof and no cause: {text!r}")
    return causes(text, frame) if asked == "cause" else proofs(text, frame, earlier)
