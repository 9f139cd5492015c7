"""Rows that may fill a gap in the evidence: near in time to it and sharing who or what acted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..logframe import LogFrame
from .running import neighbours

#: Points for what a candidate shares with any row of the evidence.
POINTS = {"username": 3, "source_ip": 4, "process_name": 2, "pid": 5, "ppid": 4, "auid": 4, "uid": 3, "audit_serial": 5, "audit_session": 6}
#: Those strong enough for a step over a third row.
STRONG = ["pid", "ppid", "auid", "uid", "audit_serial", "audit_session"]
#: Kinds of rows.
AUTH = ["user_auth", "auth", "authentication", "user_login", "login", "user_acct", "cred_acq", "cred_disp"]
NETWORK = ["network", "connection", "connect", "netflow", "socket"]
IDENTITY = [*AUTH, "user_start", "user_end", "session_open", "session_start", "session", "session_created", "process_create", "execve", "syscall"]
LOGINS = ["failed_login", "successful_login", "auth_success", "login_success"]
SESSIONS = ["session_open", "session_start", "session_created"]
SHELLS = ["sshd", "ssh", "login", "sshd-session"]
SWITCHES = ["sshd", "ssh", "login", "sudo", "su", "pkexec", "doas"]
REFUSED = "failed|failure|denied|invalid|rejected"
NEAR, BRIDGE, FILLS, BASE, WINDOW_S, MOST = 2, 7, 2, 1, 300, 25


@dataclass(frozen=True)
class Gap:
    """Which rows may fill a gap, what they must share with the evidence, and whether a third row may stand between."""

    name: str
    candidate: Column
    needs: tuple[str, ...] = ()
    bridge: bool = False
    fills: int = 0


def gap(frame: LogFrame, name: str) -> Gap:
    """``login`` (a login that went well), ``session`` (one that was opened), ``source`` (whence it came) or ``process`` (who ran it)."""
    value = lambda f: frame.value(f) if f in frame.fields else F.lit("")
    kind, action, process = value("event_type"), value("action"), value("process_name")
    text = F.lower(F.concat_ws(" ", kind, action, value("message")))
    if name == "login":
        good = action.isin("successful_login", "auth_success", "login_success", "accepted") | text.rlike("successful|accepted|granted|login succeeded|logged in")
        return Gap(name, (kind.isin(AUTH) | action.isin(LOGINS)) & ~text.rlike(REFUSED) & good)
    if name == "session":
        return Gap(name, (kind.isin("session_open", "session_start", "session") | action.isin(SESSIONS) | ((kind == "user_start") & (value("audit_session") != ""))) & ~text.rlike(REFUSED))
    if name == "source":
        return Gap(name, (value("source_ip") != "") & (kind.isin(AUTH + NETWORK) | action.isin(LOGINS) | process.isin(SHELLS)), ("username",), fills=FILLS)
    if name == "process":
        return Gap(name, (value("username") != "") & (kind.isin(IDENTITY) | action.isin(LOGINS + SESSIONS) | process.isin(SWITCHES)), ("process_name", "source_ip", *STRONG), True, FILLS)
    raise ValueError(f"unknown gap {name!r}")


def _links(rows: LogFrame, keys: DataFrame, fields: list[str]) -> DataFrame:
    """pos, points, shared (fields) of rows that hold one of the keys (field, value). Keys are distinct, so a value of many rows is met once by each."""
    points = F.create_map(*(F.lit(x) for pair in POINTS.items() for x in pair))
    hits = rows.long(fields).join(keys, ["field", "value"], "left_semi")
    return hits.groupBy("pos").agg(F.sum(points[F.col("field")]).alias("points"), F.array_sort(F.collect_set("field")).alias("shared"))


def search(frame: LogFrame, evidence: DataFrame, name: str, seconds: int = WINDOW_S) -> DataFrame:
    """pos, score, shared (fields, joined by commas), bridged and micros (to the nearest row of the evidence) of the candidates for a gap beside ``evidence`` (pos).

    Points for shared values add up, nearness in time gives NEAR more, a bridge BRIDGE and what the gap lacks ``fills``. Candidates further than ``seconds`` from all evidence, or
    without a time, are left out. A row of strong identity in common with the evidence and near it is a bridge; it must share a strong identity with the
    candidate too. Evidence without users asks for the same process where ``source`` needs the user.
    """
    wanted = gap(frame, name)
    fields = [f for f in POINTS if f in frame.fields]
    strong = [f for f in STRONG if f in fields]
    known = evidence.select("pos").distinct()
    anchors = frame.on(frame.df.join(known, "pos", "left_semi"))
    keys = anchors.long(fields).select("field", "value").distinct()
    others = frame.df.join(known, "pos", "left_anti")
    # times of all rows, marked where they are the evidence's
    times = frame.df.select("pos", "us").where("us is not null").join(known.withColumn("of", F.lit(True)), "pos", "left").withColumn("anchor", F.when(F.col("of"), F.col("us")))
    gone = neighbours(times, ["us", "pos"], "anchor").where("of is null").select("pos", F.least(F.col("us") - F.col("before"), F.col("after") - F.col("us")).alias("micros"))
    near = gone.where(F.col("micros") <= seconds * 1_000_000)
    candidates = frame.on(others.where(wanted.candidate))
    out = candidates.df.select("pos").join(near, "pos").join(_links(candidates, keys, fields), "pos", "left")
    shared = F.coalesce("shared", F.array().cast("array<string>"))
    out = out.withColumns({"points": F.coalesce("points", F.lit(0)), "shared": shared})
    if wanted.name == "source":
        users = keys.where("field = 'username'").limit(1).select(F.lit(True).alias("some")).agg(F.count("*") > 0).scalar()
        direct = F.when(users, F.array_contains("shared", "username")).otherwise(F.array_contains("shared", "process_name"))
    else:
        needs = [f for f in wanted.needs if f in fields]
        direct = F.arrays_overlap("shared", F.array(*map(F.lit, needs))) if wanted.needs else F.lit(True)
    bridged = F.lit(False)
    if wanted.bridge and strong:
        middle = frame.on(others.join(near.select("pos"), "pos", "left_semi"))
        bridges = _links(middle, keys, strong).select("pos", F.lit(1).alias("one"))
        over = frame.on(others.join(bridges, "pos", "left_semi")).long(strong).select("field", "value").distinct()
        linked = _links(candidates, over, strong).select("pos", F.lit(True).alias("over"))
        out, bridged = out.join(linked, "pos", "left"), ~direct & F.coalesce("over", F.lit(False))
    out = out.withColumns({"direct": direct, "bridged": bridged}).where("direct OR bridged")
    score = F.lit(BASE + NEAR + wanted.fills) + F.col("points") + F.when(F.col("bridged"), BRIDGE).otherwise(0)
    return out.select("pos", score.cast("long").alias("score"), F.array_join("shared", ",").alias("shared"), "bridged", "micros")


def representatives(frame: LogFrame, found: DataFrame, fields: list[str], most: int = MOST) -> DataFrame:
    """The best candidate of each combination of fields: pos, score, micros and n_alike, best first, at most ``most`` of them.

    One partial aggregate for each combination, then a top-k: no group is ever sorted.
    """
    signed = found.join(frame.df.select("pos", *(frame.value(f).alias(f"_{f}") for f in fields)), "pos")
    best = F.struct((-F.col("score")).alias("rank"), "micros", "pos", "score")
    one = signed.groupBy(*(f"_{f}" for f in fields)).agg(F.min(best).alias("b"), F.count("*").alias("n_alike"))
    return one.select("b.pos", "b.score", "b.micros", "n_alike").orderBy(F.desc("score"), "micros", "pos").limit(most)
