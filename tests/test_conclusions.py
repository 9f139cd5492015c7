"""Questions for proof and causes, and what earlier questions named."""

import pytest
from pyspark.sql import functions as F

from tidelog.logframe import LogFrame
from tidelog.plans.conclusions import asked_for, carried, causes, kind, observations, proofs, sides, statement, with_earlier
from tidelog.plans.questions import answer

FIELDS = ("event_type", "username", "source_ip", "action", "session_id", "message", "severity")


@pytest.fixture
def frame(spark):
    rows = [("auth", "svc_backup", "198.51.100.23", "failed_login", None)] * 5 + [("auth", "svc_backup", "198.51.100.23", "failed_login", "S9")]
    rows += [("net", "amy", "203.0.113.5", "allowed", "S1"), ("net", "amy", "203.0.113.5", "allowed", "s9 "), ("net", "bob", "203.0.113.6", "allowed", None), ("auth", "svc_backup", "198.51.100.23", "successful_login", ""), (None,) * 5]
    df = spark.createDataFrame([(k, *r, None, None) for k, r in enumerate(rows)], "pos long, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("ts", F.lit(None).cast("timestamp"))
    return LogFrame(df, FIELDS)


def rows(df):
    return {(r.part, r.field, r.value): r.n for r in df.collect()}


def test_kinds():
    assert [kind(q) for q in ("Do the logs prove that svc_backup was compromised?", "Did the failures cause the outage?", "Was the outage due to failures?", "How many failures were there?")] == ["proof", "cause", "cause", None]
    assert sides("Was the outage caused by the failed logins?") == ("failed logins", "outage") and sides("Did the failed logins lead to the outage?") == ("failed logins", "outage")
    assert asked_for("Do these events prove data exfiltration to 10.20.1.10?") == ["exfiltration"]
    said = statement("Do the logs prove that svc_backup was compromised?").lower()
    assert "do not prove compromise" in said and "additional evidence" in said and "was compromised" not in said
    assert "causation is not established" in statement("Did the failures cause the outage?").lower()


def test_causes(frame):
    got = rows(answer("Did the failed logins from 198.51.100.23 cause the allowed requests from 203.0.113.5?", frame))
    assert got == {("first", "action", "failed_login"): 6, ("second", "action", "allowed"): 2, ("shared", "session_id", "s9"): 2}
    assert rows(causes("Were the allowed requests from 203.0.113.6 caused by failed logins?", frame)) == {("first", "action", "failed_login"): 6, ("second", "action", "allowed"): 1}
    assert rows(causes("Did the eruption cause the tsunami?", frame)) == {("first", "action", ""): 0, ("second", "action", ""): 0}


def test_proofs(frame):
    question = "Do the logs prove that user svc_backup was compromised?"
    earlier = ["How many events came from 203.0.113.5?", "How many events has user amy?"]
    assert rows(proofs(question, frame, earlier)) == {("matching", "", ""): 7, ("outcome", "action", "failed_login"): 6, ("outcome", "action", "successful_login"): 1, ("earlier", "source_ip", "203.0.113.5"): 2}
    assert rows(observations("Is there proof of an intrusion?", frame)) == {("matching", "", ""): 0}
    with pytest.raises(ValueError):
        observations("How many failures were there?", frame)


def test_earlier_questions(frame):
    earlier = ["How many events came from 198.51.100.23?", "How many events has user amy?", "How many events has user svc_backup?"]
    values = lambda cs: [c["value"] for c in cs]
    assert values(carried("", earlier)) == ["svc_backup", "amy", "198.51.100.23"] and values(carried("", ["user amy"] + ["no one"] * 4)) == []
    assert values(with_earlier("How many failures has this user?", earlier)) == ["failed_login", "svc_backup", "198.51.100.23"]
    count = lambda q: answer(q, frame, earlier=earlier).first()["count"]
    assert count("How many failed events has the same user?") == 6 and count("How many failed events are there?") == 6 and count("How many events are there?") == 11
    assert count("How many events has this user?") == 7
