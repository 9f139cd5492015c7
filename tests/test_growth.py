"""What only larger tables show: frames that are gone through anew for each row, and identities beyond small numbers."""

import os
import re

import pytest
from pyspark.sql import functions as F

import oracle
from tidelog import queries
from tidelog.functions import parse_time
from tidelog.logframe import LogFrame
from tidelog.operators import correlation, sequences
from tidelog.operators.running import neighbours


def windows(df) -> list[str]:
    """The frames of a plan's windows."""
    return re.findall(r"specifiedwindowframe\([^)]*\)?[^)]*\)", df._jdf.queryExecution().optimizedPlan().toString())


def test_no_frame_ends_behind_the_last_row(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 7 == 3, F.col("id")).alias("value"))
    rows = spark.range(9).select(F.col("id").alias("pos"), parse_time(F.lit("2024-01-01 00:00:00")).alias("ts"), F.lit("u").alias("username"), F.when(F.col("id") % 3 == 2, "successful_login").otherwise("failed_login").alias("action"))
    chained = sequences.auth_chains(LogFrame(rows, ("username", "action")))
    for out in (neighbours(df, ["id"], "value"), chained):
        frames = windows(out)
        assert frames and not any("unboundedfollowing" in f for f in frames)
    assert sorted((r.failed, r.success) for r in chained.collect()) == [(0, 2), (1, 2), (3, 5), (4, 5), (6, 8), (7, 8)]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The test tables with events and users as a large table numbers them: events around a million, users beyond 4096 and beyond a million."""
    home = tmp_path_factory.mktemp("shifted")
    for name in oracle.TABLES:
        if name != "events":
            os.symlink(f"{SF}/{name}.parquet", home / f"{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + 999_500)
    events.withColumn("user_id", F.col("user_id") + F.when(F.col("user_id") % 3 == 0, 5_000).otherwise(1_048_570)).coalesce(1).write.parquet(str(home / "e"))
    (part,) = (home / "e").glob("*.parquet")
    os.rename(part, home / "events.parquet")
    return str(home)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["case_evidence", "case_lineage", "evidence_upsert", "evidence_reattach", "ioc_counts", "syslog_parse", "claims_judged"])
def test_large_numbers(spark, shifted, name):
    assert oracle.compare(queries.QUERIES[name](spark, shifted), oracle.connect(shifted), queries.ORACLES[name]) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_evidence_ids_are_distinct_beyond_a_million(spark, shifted):
    rows = queries.QUERIES["case_lineage"](spark, shifted).select("case_id", "place", "evidence_id").collect()
    assert len({r.evidence_id for r in rows}) == len(rows) and any(len(r.evidence_id) == 10 for r in rows)


def test_equal_groups_meet_the_least_of_them_only(spark):
    held = {1: "xy", 2: "xy", 3: "xy", 4: "y", 5: "z", 6: "xyy", 7: "z"}
    rows = [(g, "f", v) for g, vs in held.items() for v in vs]
    got = correlation.set_overlap(spark.createDataFrame(rows, "group long, field string, value string"), {"f": 2}).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2, 4), (1, 3, 2, 4), (1, 4, 1, 2), (1, 6, 2, 4), (5, 7, 1, 2)]


def test_case_similarity_lists_pairs_of_equal_groups(spark, tmp_path):
    """Users 1 and 2 are equal, and each of them has its pair with user 3."""
    rows = [(k, f"2024-01-0{day} 10:00:00", user, props) for k, (user, day, props) in enumerate([(1, 1, "p"), (1, 2, "q"), (2, 1, "p"), (2, 2, "q"), (3, 1, "q"), (4, 5, "r")])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["case_similarity"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b, r.n_shared, r.score) for r in got) == [(1, 2, 4, 10), (1, 3, 2, 5), (2, 3, 2, 5)]
