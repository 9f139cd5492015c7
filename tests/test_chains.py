"""Chains, paths, budgets, dashboards and pages against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.functions import parse_time
from tidelog.logframe import LogFrame
from tidelog.operators import chains, dashboards, retrieval
from tidelog.plans import PlanError, finalize

FIELDS = ("event_type", "username", "source_ip", "action", "severity", "process_name", "message")


def log(spark, rows):
    df = spark.createDataFrame([(k, r.get("ts"), *(r.get(f) for f in FIELDS)) for k, r in enumerate(rows)], "pos long, ts string, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("ts", parse_time(F.col("ts")))
    return LogFrame(df.withColumn("us", F.unix_micros("ts")), FIELDS)


def test_chain_goes_by_time(spark):
    frame = log(spark, [{"ts": "2024-01-01T00:10:00Z", "username": "b", "source_ip": "1"}, {"ts": "2024-01-01T00:00:00Z", "username": "a", "event_type": "x"}, {"username": "b"}, {"ts": "2024-01-01T00:14:59Z", "username": " B "}, {"ts": "2024-01-01T00:11:00Z", "username": "other"}])
    got = [tuple(r) for r in chains.chain(frame, frame.df.where("pos <> 4")).orderBy("step").collect()]
    assert got == [(1, 1, "event_type=x; username=a", ""), (2, 0, "source_ip=1; username=b", "username,temporal"), (3, 3, "username=b", "username"), (4, 2, "username=b", "")]
    assert chains.chain(frame, frame.df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_paths_are_shortest(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(22)] + [("hub", f"n{k}") for k in range(0, 25, 9)] * (seed == 2)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, parent, front = {"n0": 0, "alone": 0}, {"n0": None, "alone": None}, ["n0", "alone"]
    for d in range(1, 5):
        found = {b: min(a for a in front if b in near.get(a, ())) for a in front for b in near.get(a, ()) if b not in depth}
        depth |= dict.fromkeys(found, d)
        parent |= found
        front = list(found)
    df = spark.createDataFrame(edges, "source string, target string")
    starts = spark.createDataFrame([("n0",), ("alone",), (None,), ("n0",)], "node string")
    assert {r.node: (r.depth, r.parent) for r in chains.reach(df, starts, 4).collect()} == {n: (depth[n], parent[n]) for n in depth}
    goals = spark.createDataFrame([(f"n{k}",) for k in range(25)] + [("nowhere",)], "node string")
    for r in chains.paths(df, starts, goals, 4).collect():
        assert len(r.path) == r.depth + 1 == depth[r.goal] + 1 and r.path[0] == "n0" and r.path[-1] == r.goal
        assert all(b in near[a] for a, b in zip(r.path, r.path[1:]))


def test_budget_ends_where_the_next_row_would_not_fit(spark):
    rows = [(k, "x" * (k * 7 % 23), -k) for k in range(60)] + [(99, None, -100)]
    df = spark.createDataFrame(rows, "pos long, text string, score long")
    got = {r.pos: (r.tokens, r.before, r.part) for r in retrieval.within_budget(df, F.col("text"), 100, [F.desc("score"), F.col("pos")], 30).collect()}
    want, before = {}, 0
    for pos, text, _ in rows:
        tokens = -(-len(text or "") // 4)
        if before + tokens <= 100:
            want[pos] = (tokens, before, before // 30)
        before += tokens
    assert got == want


def test_dashboards_count_all_facets(spark):
    rng = random.Random(1)
    rows = [{"ts": f"2024-01-01T{rng.randrange(24):02}:00:00Z" if rng.random() < 0.9 else None, "username": rng.choice(["", None, " A", "a", "b", "c"]), "source_ip": f"10.0.0.{rng.randrange(30)}", "action": rng.choice(["failed_login", "ok", None]), "severity": rng.choice(["HIGH", "low", None])} for _ in range(200)]
    got = dashboards.dashboard(log(spark, rows), "authentication", 3).collect()
    assert next((r.n_rows, r.value, r.first, r.last) for r in got if r.facet == "all") == (200, None, 0, 199)
    assert sum(r.n_failed for r in got if r.facet == "all") == sum(r["action"] == "failed_login" for r in rows)
    for facet in ("username", "source_ip"):
        counts = Counter((r[facet] or "").strip().lower() for r in rows)
        counts.pop("", None)
        assert sorted((r.value, r.n_rows) for r in got if r.facet == facet) == sorted(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3])
    assert {r.facet for r in got} == {"all", "username", "source_ip", "action", "hour"}
    with pytest.raises(ValueError):
        dashboards.dashboard(log(spark, rows[:1]), "x")


def test_page_and_count_of_one_scan(spark):
    frame = log(spark, [{"username": "a" if k % 3 else "b"} for k in range(100)])
    leaf = {"operation": "EXACT", "field": "username", "value": "b"}
    tell = lambda plan: {(r["count"], r.returned_count, r.truncated, r.exhaustive) for r in finalize(plan, frame).collect()}
    assert tell(leaf | {"limit": 5}) == {(34, 5, True, False)} and tell(leaf) == tell(leaf | {"limit": 34}) == {(34, 34, False, True)}
    assert [r.pos for r in finalize(leaf | {"limit": 3}, frame).orderBy("pos").collect()] == [0, 3, 6]
    assert finalize(leaf | {"value": "z"}, frame).count() == 0
    with pytest.raises(PlanError):
        finalize({"operation": "COUNT", "conditions": [leaf]}, frame)
