"""Questions about what came after something else."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import parse_time
from tidelog.logframe import LogFrame
from tidelog.plans.questions import after, anchored, answer, named_action

FIELDS = ("event_type", "username", "source_ip", "action", "message", "severity")


@pytest.fixture
def frame(spark):
    rows = [("failed_login", "bob", f"2024-01-01T08:0{k}:00Z") for k in range(1, 7)]
    rows += [("successful_login", "bob", "2024-01-01T08:03:00Z"), ("successful_login", "bob", "2024-01-01T09:01:00Z"), ("successful_login", "bob", "2024-01-01T09:02:00Z"), ("successful_login", "amy", "2024-01-01T08:30:00Z")]
    rows += [("failed_login", "amy", "2024-01-01T10:00:00Z"), ("session_end", "bob", "2024-01-01T08:30:00Z"), ("successful_login", "bob", None), ("successful_login", "bob", "2024-01-01T08:06:00Z"), (None, None, None)]
    df = spark.createDataFrame([(k, ts, None, u, "198.51.100.23", a, None, None) for k, (a, u, ts) in enumerate(rows)], "pos long, ts string, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("ts", parse_time(F.col("ts")))
    return LogFrame(df, FIELDS)


def test_counts_after_the_last_failure(frame):
    count = lambda q: answer(q, frame).first()["count"]
    assert count("How many successful logins of user bob were there after the failures?") == 3  # 9:01, 9:02, and 8:06 behind the failure in the log
    assert count("How many successful logins of user bob were there after his failed attempts?") == 3
    assert count("How many successful logins of user bob were there?") == 5
    assert count("How many successful logins were there after the failures?") == 0  # amy's comes last
    assert count("How many successful logins were there after the eruption?") == 0


def test_phrases(frame):
    assert anchored("How many after the failures?") == ("How many ", "failures") and anchored("events after 2024-01-01") == ("events after 2024-01-01", None)
    assert [named_action(p, frame) for p in ("the failures", "sessions ended", "success of a login", "log", "xy")] == ["failed_login", "session_end", "successful_login", "failed_login", None]
    assert after(frame, "nothing of it", []).df.count() == 0
