"""Assessments of cases, their findings and what stays open."""

from tidelog.operators import casebook

ROWS = [
    ("C1", "EV-1", "failed_login", "USER_AUTH", "Repeated failures from 192.168.4.155 (174 attempts)", None, "192.168.4.155", "bob", ""),
    ("C1", "EV-2", None, "USER_AUTH", "pam: res=failed", None, None, "bob", None),
    ("C1", "EV-3", "run", "EXECVE", "x", "id", None, " ", None),
    ("C2", "EV-4", "successful_login", "USER_AUTH", "ok", None, "10.0.0.1", "amy", None),
    ("C3", "EV-5", None, None, None, None, None, None, None),
]
SCHEMA = "case_id string, evidence_id string, action string, event_type string, message string, command string, source_ip string, username string, process_name string"


def test_assessment(spark):
    evidence, cases = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([("C1",), ("C2",), ("C3",), ("C4",), ("C4",)], "case_id string")
    got = {r.case_id: r for r in casebook.assess(evidence, cases).collect()}
    assert (got["C1"].n_failed, got["C1"].attempts, got["C1"].n_runs, got["C1"].n_shared, got["C1"].n_users) == (2, 174, 1, 1, 1) and "at least 174" in got["C1"].summary
    assert [got[k].summary for k in ("C2", "C3", "C4")] == ["Activity for review.", "Activity for review.", "No evidence is linked."]
    found = [tuple(r) for r in casebook.findings(evidence, cases).orderBy("case_id", "finding").collect()]
    assert found[:3] == [("C1", "F-001", "OBSERVED", "HIGH", 2), ("C1", "F-002", "CORRELATION", "MEDIUM", 1), ("C1", "F-003", "LIMITATION", "HIGH", 3)]
    assert found[3:] == [(c, "F-001", "LIMITATION", "HIGH", n) for c, n in (("C2", 1), ("C3", 1), ("C4", 0))]
    behind = {(r.case_id, r.classification, r.evidence_id) for r in casebook.support(evidence).collect()}
    assert {e for c, k, e in behind if (c, k) == ("C1", "CORRELATION")} == {"EV-1", "EV-2"} == {e for c, k, e in behind if (c, k) == ("C1", "OBSERVED")} and len(behind) == 9
    told = {}
    for r in casebook.open_points(evidence, cases).orderBy("place").collect():
        told.setdefault((r.case_id, r.kind), []).append(r.text)
    assert len(told["C1", "uncertainty"]) == 6 and len(told["C1", "action"]) == 4 and len(told["C4", "uncertainty"]) == 2 and len(told["C4", "action"]) == 1
    assert {(r.field, r.value) for r in casebook.names(evidence).where("case_id = 'C1'").collect()} == {("source_ip", "192.168.4.155"), ("username", "bob")}
    assert casebook.assess(evidence.limit(0)).count() == 0


def test_explanations(spark):
    findings = spark.createDataFrame([("f1", "T", "HIGH", " seen "), ("f2", " ", None, None)], "finding_id string, title string, confidence string, interpretation string")
    evidence = spark.createDataFrame([("f1", "EV-1"), ("f1", "EV-1"), ("f1", " "), ("f1", None), ("f3", "EV-9")], "finding_id string, evidence_id string")
    related = spark.createDataFrame([("f1", "login")], "finding_id string, text string")
    got = [tuple(r) for r in casebook.explain(findings, evidence, related).orderBy("finding_id").collect()]
    assert got == [("f1", "T", "HIGH", "seen", 1, 1, ""), ("f2", "f2", "Not stated", "", 0, 0, "no evidence; nothing related; no confidence stated")]
