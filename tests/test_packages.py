"""Packages of cases between two workspaces."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import packages
from tidelog.operators.cases import missing

EVIDENCE, CASES = "evidence_id string, file string, line long, timestamp string, note string", "case_id string, title string, evidence_ids array<string>"


def test_numbers_follow_the_store(spark, tmp_path):
    theirs = spark.createDataFrame([("EV-000001", "a", 1, "t", "x"), ("EV-000002", "a", 2, "t", None), ("EV-000003", "b", 1, None, "y"), ("EV-000009", "z", 9, "t", "unnamed")], EVIDENCE)
    sent = spark.createDataFrame([("C-1", "one", ["EV-000002", "EV-000001"]), ("C-2", "two", ["EV-000003", "EV-000001"]), ("C-3", None, [])], CASES)
    packages.export(sent, theirs, str(tmp_path / "p"))
    ours = spark.createDataFrame([("EV-000001", "q", 5, "t", "own"), ("EV-000007", "a", 1, "t", "own")], EVIDENCE)
    cases = spark.createDataFrame([("C-1", "ours", ["EV-000001"])], CASES)
    after, store = packages.take_in(str(tmp_path / "p"), cases, ours)
    rows = {r.evidence_id: (r.file, r.line, r.note) for r in store.collect()}
    assert rows["EV-000007"] == ("a", 1, "own") and rows["EV-000001"] == ("q", 5, "own") and len(rows) == 4 and ("z", 9, "unnamed") not in rows.values()
    named = {r.case_id: (r.title, [rows[e][:2] for e in r.evidence_ids]) for r in after.collect()}
    renamed = next(c for c in named if c.startswith("C-1-"))
    assert named == {"C-1": ("ours", [("q", 5)]), renamed: ("one", [("a", 2), ("a", 1)]), "C-2": ("two", [("b", 1), ("a", 1)]), "C-3": (None, [])}
    assert missing(after, store).count() == 0
    again, _ = packages.take_in(str(tmp_path / "p"), after, store)
    assert sorted(r.case_id for r in again.collect()) == sorted(named)


def test_nothing_of_a_changed_package_is_taken(spark, tmp_path):
    theirs = spark.createDataFrame([("EV-000001", "a", 1, "t", "x")], EVIDENCE)
    sent = spark.createDataFrame([("C-1", "one", ["EV-000001"])], CASES)
    packages.export(sent, theirs, str(tmp_path / "p"))
    theirs.withColumn("note", F.lit("changed")).write.mode("overwrite").parquet(str(tmp_path / "p/evidence"))
    with pytest.raises(packages.PackageError, match="evidence"):
        packages.take_in(str(tmp_path / "p"), sent.limit(0), theirs.limit(0))
    with pytest.raises(packages.PackageError, match="lacks"):
        packages.export(sent, theirs.limit(0), str(tmp_path / "q"))
    assert not (tmp_path / "q").exists()
