"""Groups that share much, against brute force."""

import random

import pytest

from tidelog.operators import likeness
from tidelog.operators.likeness import similar

WEIGHTS = {"user": 4, "ip": 2, "day": 1}


def brute(rows, least):
    sets = {}
    for g, f, v in rows:
        if f in WEIGHTS:
            sets.setdefault(g, set()).add((f, v))
    of = {}
    for g in sorted(sets):
        of.setdefault(frozenset(sets[g]), g)
    reps = sorted(of.values())
    pairs = {}
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            both = sets[a] & sets[b]
            if (score := sum(WEIGHTS[f] for f, _ in both)) >= least:
                pairs[a, b] = (len(both), score)
    return pairs, {g: of[frozenset(s)] for g, s in sets.items()}


@pytest.mark.parametrize("least", [1, 5, 9])
def test_pairs_equal_brute_force(spark, least):
    r = random.Random(7)
    rows = [(g, f, str(r.randrange(n))) for g in range(60) for f, n in (("user", 12), ("ip", 8), ("day", 3), ("other", 2)) for _ in range(r.randrange(4))]
    rows += [(100 + g, f, v) for g in range(5) for _, f, v in [x for x in rows if x[0] == 3]] + rows[:20]
    pairs, members = similar(spark.createDataFrame(rows, "group int, field string, value string"), WEIGHTS, least)
    want_pairs, want_members = brute(rows, least)
    assert {(p.a, p.b): (p.n_shared, p.score) for p in pairs.collect()} == want_pairs
    assert {m.group: m["class"] for m in members.collect()} == want_members


@pytest.mark.parametrize("least", [1, 5, 9])
def test_blocks_and_rare_values_equal_brute_force(spark, monkeypatch, least):
    for name, size in (("COMMON", 6), ("COLUMNS", 9), ("BLOCK", 8), ("TASKS", 5)):
        monkeypatch.setattr(likeness, name, size)
    r = random.Random(8)
    rows = [(g, f, str(r.randrange(n))) for g in range(60) for f, n in (("user", 40), ("ip", 12), ("day", 3)) for _ in range(r.randrange(5))]
    pairs, _ = similar(spark.createDataFrame(rows, "group int, field string, value string"), WEIGHTS, least)
    got = [tuple(p) for p in pairs.collect()]
    assert len(got) == len({p[:2] for p in got}) and {p[:2]: p[2:] for p in got} == brute(rows, least)[0]


def test_common_values_list_no_joined_pairs(spark):
    """Groups that differ but share common values are compared in blocks: nothing is joined on a value that most of them have."""
    r = random.Random(9)
    rows = [(g, "day", str(v)) for g in range(400) for v in r.sample(range(20), 12)]
    pairs, _ = similar(spark.createDataFrame(rows, "group int, field string, value string"), WEIGHTS, 9)
    assert "FlatMapCoGroupsInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(p.a, p.b): (p.n_shared, p.score) for p in pairs.collect()} == brute(rows, 9)[0]


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], "group int, field string, value string")
    assert [df.count() for df in similar(empty, WEIGHTS, 3)] == [0, 0]
    with pytest.raises(ValueError):
        similar(empty, WEIGHTS, 0)


@pytest.mark.parametrize("common", [64, 6, 1])
def test_all_pairs_equal_brute_force(spark, monkeypatch, common):
    """Every pair that shares a value, equal groups included; with common=1 no value is common, with 6 some groups have none that is."""
    for name, size in (("COMMON", common), ("COLUMNS", 9), ("BLOCK", 8), ("TASKS", 5), ("SENT", 3)):
        monkeypatch.setattr(likeness, name, size)
    r = random.Random(10)
    rows = [(g, f, str(r.randrange(n))) for g in range(60) for f, n in (("user", 40), ("ip", 12), ("day", 3), ("other", 2)) for _ in range(r.randrange(4))]
    rows += [(100 + g, f, v) for g in range(5) for _, f, v in [x for x in rows if x[0] == 3]] + rows[:20] + [(None, "day", "1"), (7, "day", None), (8, "day", None)]
    sets = {}
    for g, f, v in rows:
        if f in WEIGHTS and g is not None and v is not None:
            sets.setdefault(g, set()).add((f, v))
    want = {(a, b): (len(sets[a] & sets[b]), sum(WEIGHTS[f] for f, _ in sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = [tuple(p) for p in likeness.overlaps(spark.createDataFrame(rows, "group int, field string, value string"), WEIGHTS).collect()]
    assert len(got) == len(want) and {p[:2]: p[2:] for p in got} == want


def test_all_pairs_of_one_value_are_not_joined(spark):
    """A value that all groups have makes no joined rows: only blocks meet."""
    sets = spark.range(300).selectExpr("id AS group", "'day' AS field", "'1' AS value")
    pairs = likeness.overlaps(sets, WEIGHTS)
    assert "FlatMapCoGroupsInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 300 * 299 // 2
