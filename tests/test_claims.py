"""Claims against cited evidence and counts."""

from tidelog.operators import claims
from tidelog.operators.claims import judge, key, needed, shown

LOGINS = [(f"EVID-{k:03d}", f"failed_login from 198.51.100.23 user=svc_backup auth_method=ssh event_type=authentication [{k}]") for k in range(1, 13)]
COUNTS = [("failed_login 198.51.100.23", 45)]


def run(spark, text, evidence=LOGINS, cited=("EVID-001",), kind="VERIFIED_FACT", counts=None):
    rows = spark.createDataFrame([(1, text, kind, None if cited is None else list(cited))], "claim int, text string, kind string, cited array<string>")
    known = spark.createDataFrame(evidence, "evidence_id string, text string")
    return judge(rows, known, counts and spark.createDataFrame(counts, "query string, n long")).first()


CASES = [
    ("The attacker used 198.51.100.23.", LOGINS, ["EVID-999"], None, "UNSUPPORTED_CLAIM", "Unknown evidence"),
    ("The account svc_backup was compromised by the attacker.", LOGINS, ["evid-1"], None, "UNSUPPORTED_CLAIM", "shows:compromise"),
    ("This proves data exfiltration to 192.0.2.91 succeeded.", [("E-1", "blocked outbound connection to 192.0.2.91 bytes_sent=0")], ["E-1"], None, "UNSUPPORTED_CLAIM", "shows:exfiltration"),
    ("The user escalated privileges to root.", [("E-1", "sudo command executed user=deploy uid=1000 command=ls")], ["E-1"], None, "UNSUPPORTED_CLAIM", "shows:escalation"),
    ("CVE-2026-1234 was exploited successfully.", [("E-1", "scanner report mentions CVE-2026-1234 in banner")], ["E-1"], None, "UNSUPPORTED_CLAIM", "shows:exploitation"),
    ("Something happened on the network.", LOGINS, [], None, "UNSUPPORTED_CLAIM", "no evidence"),
    ("Something happened on the network.", LOGINS, None, None, "UNSUPPORTED_CLAIM", "no evidence"),
    ("A successful login was observed for amy.", [("E-1", "failed_login user=amy res=failed")], ["E-1"], None, "CONTRADICTED_CLAIM", "opposite"),
    ("There are 45 failed logins from 198.51.100.23.", LOGINS, ["EVID-001"], COUNTS, "VERIFIED_FACT", ""),
    ("There are 900 failed logins from 198.51.100.23.", LOGINS, ["EVID-001"], COUNTS, "UNSUPPORTED_CLAIM", "deterministic full-dataset query"),
    ("There are 12 failed logins from 198.51.100.23.", LOGINS, ["EVID-001"], None, "VERIFIED_FACT", ""),
    ("There are 45 failed logins from 198.51.100.23.", LOGINS, ["EVID-001"], None, "UNSUPPORTED_CLAIM", "evidence has 12"),
    ("All failed logins were for user=svc_backup.", LOGINS, ["EVID-001"], None, "VERIFIED_FACT", ""),
    ("All failed logins were for user=svc_backup.", [*LOGINS, ("EVID-13", "failed_login user=amy")], ["EVID-001"], None, "UNSUPPORTED_CLAIM", "12 of 13"),
    ("The failed logins caused the later successful login.", LOGINS, ["EVID-001"], None, "UNSUPPORTED_CLAIM", "causal"),
    ("Failed login from 198.51.100.23 for user=svc_backup.", LOGINS, ["EVID-001"], None, "VERIFIED_FACT", ""),
    ("Failed login from 198.51.100.24 for user=svc_backup.", LOGINS, ["EVID-001"], None, "UNSUPPORTED_CLAIM", "ip:198.51.100.24"),
    ("Several logins failed.", LOGINS, ["EVID-001"], None, "UNSUPPORTED_CLAIM", "shown once"),
    ("Several logins failed.", LOGINS, ["EVID-001", "EVID-002", "EVID-002"], None, "VERIFIED_FACT", ""),
    ("Review the logins of svc_backup.", LOGINS, [], None, "RECOMMENDATION", "advice"),
    ("What the login means cannot be determined.", LOGINS, ["EVID-001"], None, "INSUFFICIENT_CONTEXT", "settle"),
    ("The login activity may be a scanner.", LOGINS, ["EVID-001"], None, "GROUNDED_INTERPRETATION", ""),
    (None, LOGINS, ["EVID-001"], None, "VERIFIED_FACT", ""),
]


def test_verdicts(spark):
    groups = {}
    for k, (text, evidence, cited, counts, verdict, reason) in enumerate(CASES):
        groups.setdefault((tuple(evidence), counts and tuple(counts)), []).append((k, text, None, cited))
    for (evidence, counts), rows in groups.items():
        told = spark.createDataFrame(rows, "claim int, text string, kind string, cited array<string>")
        got = {r.claim: r for r in judge(told, spark.createDataFrame(list(evidence), "evidence_id string, text string"), counts and spark.createDataFrame(list(counts), "query string, n long")).collect()}
        assert set(got) == {r[0] for r in rows}
        for k, r in got.items():
            assert (r.verdict, CASES[k][5] in r.reason) == (CASES[k][4], True), (CASES[k][0], r)


def test_wishes_and_denials(spark):
    assert run(spark, "A hypothesis is that the activity was an automated scanner.", kind="HYPOTHESIS")[1:3] == ("HYPOTHESIS", "ACCEPTED_AS_INTERPRETATION")
    denied = "Temporal proximity does not establish that one event caused the other."
    assert run(spark, denied, kind="GROUNDED_INTERPRETATION").verdict == "GROUNDED_INTERPRETATION"


def test_facts(spark):
    row = spark.sql("SELECT 'failed password for user root-2 from 10.0.0.9:22 port 51234 ssh2, /etc/passwd.' AS t, 'evid-007' AS i")
    got = row.select(shown("t"), needed("t"), key(row.i)).first()
    assert {"ip:10.0.0.9", "user:root-2", "port:51234", "path:/etc/passwd", "outcome:failure", "theme:authentication"} <= set(got[0]) and got[2] == "EVID-7"
    assert run(spark, "x", [], ["E-1"]).verdict == "UNSUPPORTED_CLAIM"


def test_sizes_equal_brute_force(spark):
    rows = [[f"outcome:{'failure' if k % 3 else 'success'}", f"ip:{k % 7}", f"user:{k % 5}"] for k in range(200)] + [[]]
    asked = [[], ["outcome:failure"], ["ip:3", "outcome:success"], ["ip:3", "user:2"], ["ip:9"], ["ip:1", "outcome:failure", "user:4"]]
    got = claims.sizes(spark.createDataFrame([(a,) for a in asked * 2], "population array<string>"), spark.createDataFrame([(r,) for r in rows], "facts array<string>"))
    assert {tuple(r.population): r.found for r in got.collect()} == {tuple(a): sum(set(a) <= set(r) for r in rows) for a in asked}
