"""Semantics that the tables can't exercise: nulls, odd values, formats of files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.functions import INDICATORS, norm, parse_time, private_ipv4, tokens, valid_ipv4
from tidelog.logframe import LogFrame, normalized
from tidelog.operators import aggregates, cases, correlation, detections, grounding, incident, ranking, retrieval, search, sequences
from tidelog.plans import PlanError, run
from tidelog.plans.questions import understand
from tidelog.sources import merge_audit, normalize, parse_syslog, read_json, read_syslog, sniff, verify_files, write_csv
from tidelog.sources.json_logs import flatten

FIELDS = ("event_type", "username", "source_ip", "action", "severity", "process_name", "command", "message", "destination_ip")


def log(spark, rows):
    base = {f: None for f in FIELDS}
    full = [(k, r.get("ts"), *({**base, **r}[f] for f in FIELDS)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, "pos long, ts string, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("ts", parse_time(F.col("ts")))
    return LogFrame(df, FIELDS)


def positions(df):
    return sorted(r.pos for r in df.collect())


def test_conditions_on_missing_and_odd_values(spark):
    frame = log(spark, [{"severity": " HIGH "}, {"severity": None}, {"severity": "9"}, {"severity": "10"}, {"severity": "nan"}, {"severity": "x"}, {"severity": ""}])
    leaf = {"operation": "EXACT", "field": "severity", "value": "high"}
    assert positions(run(leaf, frame)) == [0]
    assert positions(run({"operation": "NOT", "conditions": [leaf]}, frame)) == [1, 2, 3, 4, 5, 6]
    assert positions(run({"operation": "RANGE", "field": "severity", "min": 9}, frame)) == [2, 3]
    assert positions(run({"operation": "RANGE", "field": "severity", "max": 9.5}, frame)) == [2]
    assert positions(run({"operation": "AND", "conditions": []}, frame)) == list(range(7))
    assert positions(run({"operation": "OR", "conditions": []}, frame)) == []
    assert positions(run({"operation": "IN", "field": "severity", "values": []}, frame)) == []
    assert positions(run({**leaf, "limit": 0}, frame)) == []
    assert [r.pos for r in run({"operation": "SORT", "field": "severity", "descending": True}, frame).collect()][:3] == [5, 4, 0]
    assert run({"operation": "TOP_K", "field": "severity", "numeric": True, "limit": 2}, frame).count() == 2
    assert positions(run(leaf, normalized(frame))) == [0]


@pytest.mark.parametrize("plan", [{"operation": "EXACT", "field": "nothing", "value": 1}, {"operation": "MAYBE", "field": "severity"}, {"operation": "REGEX", "field": "severity", "value": "("}, {"operation": "COUNT", "conditions": [{"operation": "EXACT", "field": "x", "value": 1}]}, {"operation": "AND", "conditions": [{"operation": "COUNT"}]}, {"operation": "NOT", "conditions": []}, {"operation": "RANGE", "field": "severity", "min": "low"}, {"operation": "TIME_RANGE", "start": "soon"}, {"operation": "TIME_RANGE"}, {}])
def test_what_is_not_understood_is_refused(spark, plan):
    with pytest.raises(PlanError):
        run(plan, log(spark, [{"severity": "1"}])).collect()


def test_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02T05:04:05+02:00", "01/02/2024 03:04:05", "02/Jan/2024:03:04:05 +0000", "Jan  2 03:04:05", "no time", None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.unix_seconds(parse_time(F.col("t"), 2024)).alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == [1704164645] * 6 + [None] * 3


def test_ends_of_time_ranges_count(spark):
    frame = log(spark, [{"ts": f"2024-01-01T00:0{k}:00Z"} for k in range(5)] + [{}])
    assert positions(run({"operation": "TIME_RANGE", "start": "2024-01-01T00:01:00Z", "end": "2024-01-01T00:03:00"}, frame)) == [1, 2, 3]
    assert positions(run({"operation": "TIME_RANGE", "end": "2024-01-01T00:01:00Z"}, frame)) == [0, 1]


def test_flat_records():
    record = {"a": {"b": 1, "c": None}, "l": [1, "x", None], "o": [{"k": True}, {"k": 2}], "z": 0}
    assert flatten(record) == {"a_b": "1", "l": "1, x, ", "o_0_k": "true", "o_1_k": "2", "z": "0"}


def test_json_lines(spark, tmp_path):
    lines = ['{"timestamp": "2024-01-01T00:00:00Z", "User": "Ann", "vendor_score": 5, "nested": {"deep_field": "x"}}', "not json", "", '{"timestamp": "never", "user": "Bob", "EventID": 4625, "Severity": "HIGH"}', '{"timestamp": "never", "user": "Bob", "EventID": 4625, "Severity": "HIGH"}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    frame = normalize(read_json(spark, str(tmp_path / "a.json")))
    rows = frame.df.orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 1, 2]
    assert rows[0].username == "Ann" and rows[0].attrs["nested_deep_field"] == "x" and rows[0].attrs["vendor_score"] == "5" and not rows[0].timestamp_parse_failed
    assert rows[1].action == "failed_login" and rows[1].timestamp_parse_failed and rows[1].severity == "high"
    assert search.populated_fields(frame).where("field = 'username'").first().n_rows == 3


@pytest.mark.parametrize("text", ['[{"user": "a"}, {"user": "b"}]', '{"events": [{"user": "a"}, {"user": "b"}]}', '{"user": "a"}\n  {"user":\n "b"}', '{"meta": 1, "odd_name": [{"user": "a"}, {"user": "b"}]}'])
def test_whole_json_files(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert [r.username for r in normalize(read_json(spark, str(tmp_path / "a.json"), whole=True)).df.orderBy("pos").collect()] == ["a", "b"]


def test_syslog_and_audit(spark, tmp_path):
    lines = [
        "Jan  5 10:00:00 web1 sshd[99]: Failed password for invalid user bob from 10.0.0.9 port 22 ssh2",
        "Jan  5 10:00:01 web1 sudo: root : TTY=pts/0 ; COMMAND=/bin/cat /etc/shadow",
        'type=SYSCALL msg=audit(1704448800.123:7): pid=5 auid=1000 comm="old" comm="cat"',
        "type=EXECVE msg=audit(1704448800.123:7): argc=2 a1=2F6574632F736861646F77 a0=\"cat\" pid=6",
        "",
        "no header at all",
    ]
    (tmp_path / "s.log").write_text("\n".join(lines))
    rows = merge_audit(parse_syslog(read_syslog(spark, str(tmp_path / "s.log")), 2024)).orderBy("line").collect()
    assert len(rows) == 5
    assert (rows[0].username, rows[0].source_ip, rows[0].action, rows[0].pid, rows[0].host) == ("bob", "10.0.0.9", "failed_login", "99", "web1")
    assert rows[0].ts == dt.datetime(2024, 1, 5, 10, 0) and rows[1].command == "/bin/cat /etc/shadow"
    assert rows[3].command == "cat /etc/shadow" and rows[3].process_name == "cat" and rows[3].attrs["pid"] == "6" and rows[3].attrs["auid"] == "1000"
    assert rows[4].message == "no header at all" and rows[4].ts is None
    assert sniff(spark, str(tmp_path / "s.log")) == "syslog"


def test_sniffing(spark, tmp_path):
    for name, text, kind in (("a", '{"EventID": 1, "Computer": "x"}', "windows"), ("b", '[{"UtcTime": "x", "Image": "y"}]', "sysmon"), ("c", '{"a": 1}', "json"), ("d", "plain words\nmore", "text"), ("e", "", "text")):
        (tmp_path / name).write_text(text)
        assert sniff(spark, str(tmp_path / name)) == kind


def test_indicators(spark):
    text = "see 10.0.0.1, 999.1.1.1 and http://evil.example.com/x. lib.so d41d8cd98f00b204e9800998ecf8427e a@b.org cve-2021-4034 01.2.3.4"
    row = spark.createDataFrame([(text,)], "t string").select(*(f(F.col("t")).alias(k) for k, f in INDICATORS.items())).first()
    assert row.ipv4 == ["10.0.0.1"] and row.url == ["http://evil.example.com/x"] and row.hash == ["d41d8cd98f00b204e9800998ecf8427e"]
    assert "evil.example.com" in row.domain and "lib.so" not in row.domain and row.email == ["a@b.org"] and row.cve == ["CVE-2021-4034"]
    texts = {"from 10.0.0.9:51234 to [8.8.8.8]:53": ["10.0.0.9", "8.8.8.8"], "http://10.1.1.1:8080/x host:1.2.3.4.": ["10.1.1.1", "1.2.3.4"], "1.2.3.4.5 256.1.1.1 1.1.1.256 v1.2.3.4 1.2.3.4_": [], "0.0.0.0,255.255.255.255": ["0.0.0.0", "255.255.255.255"]}
    assert [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(INDICATORS["ipv4"](F.col("t")).alias("v")).collect()] == list(texts.values())
    hosts = {"org.freedesktop libc.so.6.bar a.b.example.com": ["a.b.example.com"], "-x.example.org, y-.example.org": ["x.example.org", "example.org"], "x" * 64 + ".com": []}
    assert [r.v for r in spark.createDataFrame([(t,) for t in hosts], "t string").select(INDICATORS["domain"](F.col("t")).alias("v")).collect()] == list(hosts.values())
    ips = spark.createDataFrame([(x,) for x in ("10.1.1.1", "172.32.0.1", "192.168.0.1", "8.8.8.8", "x", "127.0.0.1")], "ip string")
    assert [r[0] for r in ips.select(F.coalesce(valid_ipv4(F.col("ip")) & private_ipv4(F.col("ip")), F.lit(False))).collect()] == [True, False, True, False, False, True]
    assert spark.range(1).select(norm(F.lit(0)), tokens(F.lit("A-b c d_e a-b"))).first()[:] == ("0", ["a-b", "d_e"])


def test_sequences_and_detections(spark):
    rows = [{"ts": "2024-01-01T00:00:00Z", "username": "u", "source_ip": "1.1.1.1", "action": "failed_login"} for _ in range(12)]
    rows += [{"ts": "2024-01-01T00:10:00Z", "username": "u", "source_ip": "1.1.1.1", "action": "successful_login"}, {"ts": "2024-01-01T00:11:00Z", "username": "u", "source_ip": "1.1.1.1", "process_name": "pkexec", "command": "/usr/bin/pkexec id", "action": "command_exec", "destination_ip": "2.2.2.2"}, {"ts": "2024-01-01T09:00:00Z", "username": "v", "source_ip": "3.3.3.3", "action": "successful_login", "command": "ls"}]
    frame = log(spark, rows)
    assert sequences.success_after_failures(frame).collect()[0][:] == ("1.1.1.1", 12, 12, 11)
    assert sequences.auth_chains(frame).count() == 12 and sequences.auth_chains(frame, 60).count() == 0
    scores = {r.pos: r for r in detections.event_scores(frame).collect()}
    assert scores[0].score == 45 and scores[0].priority == "HIGH" and "12 attempts" in scores[0].reasons[1]
    assert detections.findings(frame).where("rule = 'PRIV-001'").count() == 1
    assert incident.attackers(frame).first().has_success_after
    assert [r.cve for r in incident.exploits(frame).collect()] == ["CVE-2021-4034"]
    assert positions(correlation.scope(frame, frame.df.where("pos = 0").select("username", "source_ip"))) == list(range(14))
    benign = log(spark, [{"action": "start", "username": "root", "command": "ls"}] * 5)
    assert incident.profile(benign).count() == 0 and incident.attackers(benign).count() == 0
    assert aggregates.coverage(benign, F.lit(False)).first().level == "UNKNOWN"


def test_near_in_time_equals_brute_force(spark):
    rows = spark.range(60).selectExpr("id AS pos", "id * id * 7000000 AS us", "id % 3 AS k")
    got = {(r.source, r.target) for r in correlation.temporal_edges(rows, 300, ["k"]).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3 and (b * b - a * a) * 7 <= 300}


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "failed login of root"), (2, "login ok"), (3, None), (4, "nothing here")], "id long, text string")
    assert [r.id for r in retrieval.bm25(docs, "failed logins", "id", "text").orderBy(F.desc("score")).collect()] == [1, 2]
    assert max(ranking.hybrid(docs, "failed login", "id", "text").collect(), key=lambda r: r.score).id == 1
    assert retrieval.bm25(docs, "zebra", "id", "text").count() == 0


def test_cases_and_claims(spark, tmp_path):
    store = spark.createDataFrame([("EV-000007", "f", 1, "t")], "evidence_id string, file string, line int, timestamp string")
    new = spark.createDataFrame([("", "f", 1, "t"), ("", "f", 2, "t"), ("", "f", 2, "t")], store.schema)
    both = cases.add_evidence(store, new)
    assert sorted(r.evidence_id for r in both.collect()) == ["EV-000007", "EV-000008"]
    assert cases.add_evidence(store.limit(0), new.limit(0)).count() == 0
    one = spark.createDataFrame([("C1", ["EV-000007", "EV-000009"])], "case_id string, evidence_ids array<string>")
    assert [r.evidence_id for r in cases.missing(one, both).collect()] == ["EV-000009"]
    assert cases.link(one, "C1", ["EV-000009", "EV-1"]).first().evidence_ids == ["EV-000007", "EV-000009", "EV-1"]
    changed = cases.update_evidence(store, spark.createDataFrame([("EV-000007", "g", None)], "evidence_id string, file string, line int")).first()
    assert (changed.file, changed.line) == ("g", 1)
    claims = spark.createDataFrame([(1, "12 failures were seen [EV-000007] [EV-000001]"), (2, None)], "claim int, text string")
    assert [r.kind for r in grounding.classify(claims).orderBy("claim").collect()] == ["COUNT", "OBSERVATION"]
    assert {(r.cited, r.known) for r in grounding.citations(claims, store).collect()} == {("EV-000007", True), ("EV-000001", False)}
    assert "<td>EV-000007</td>" in cases.html_report("R", {"e": store})
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.txt").write_text("abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    ok = verify_files(spark, str(tmp_path / "x"), spark.createDataFrame([("f.txt", digest), ("g.txt", digest)], "name string, sha256 string"))
    assert {(r.name, r.ok) for r in ok.collect()} == {("f.txt", True), ("g.txt", False)}
    write_csv(one.withColumn("n", F.lit(None).cast("int")), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape="\\").first().case_id == "C1"


def test_questions_are_understood():
    q = understand("How many failed logins of user bob from 10.0.0.1 in the last 2 hours?")
    assert (q.intent, q.last_seconds) == ("count", 7200)
    assert {(c["field"], c["value"]) for c in q.conditions} == {("action", "failed_login"), ("source_ip", "10.0.0.1"), ("username", "bob")}


def test_streams_equal_batches(spark, tmp_path):
    from tidelog.streaming import auth_chains, histogram, table_stream

    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=5 * k), k % 2, "error" if k % 3 else "purchase") for k in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "e"))
    for name, make, mode in (("hist", lambda s: histogram(s, 3600), "complete"), ("chains", auth_chains, "append")):
        query = make(table_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("hist").agg(F.sum("count")).first()[0] == 40
    want = {(a, b) for a, t1, u1, e1 in rows for b, t2, u2, e2 in rows if e1 == "error" and e2 == "purchase" and u1 == u2 and 0 <= (t2 - t1).total_seconds() <= 900}
    assert {(r.failed, r.success) for r in spark.table("chains").collect()} == want


def test_spans_and_blocks_change_nothing(spark):
    """A hot entity is cut into spans: the borders must not show, whatever the span."""
    rows = [(p, t, "a" if p % 3 else "b") for p, t in enumerate([0, 0, 5, 5, 6, 30, 31, 31, 90, 100, 4000, 4001, 9000, None])]
    df = spark.createDataFrame(rows, "pos bigint, s bigint, username string").selectExpr("pos", "timestamp_seconds(s) AS ts", "username")
    log = LogFrame(df, ("username",))
    want = []
    for u in "ab":
        own = sorted((t * 1_000_000, p) for p, t, name in rows if name == u and t is not None)
        want += [(p, q, b - a) for (a, p), (b, q) in zip(own, own[1:])]
    for span in (1, 7, 100_000):
        assert sorted(map(tuple, sequences.steps(log, span=span).collect())) == sorted(want)
    for gap in (1, 4, 60):
        got = sequences.sessions(log, gap).collect()
        assert sum(r.n_events for r in got) == 13
        for u in "ab":
            times = sorted(t for _, t, name in rows if name == u and t is not None)
            assert sum(r.entity == u for r in got) == 1 + sum(b - a > gap for a, b in zip(times, times[1:]))
    ids = spark.createDataFrame([("g", n) for n in (0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 20, 21, 23, 23)] + [("h", 2), ("h", 3), ("h", None)], "g string, n bigint")
    for block in (1, 2, 3, 100):
        got = {(r.g, r.first, r.last, r.n) for r in sequences.consecutive_runs(ids, "g", "n", block).collect()}
        assert got == {("g", 0, 3, 4), ("g", 5, 11, 7), ("g", 20, 21, 2), ("g", 23, 23, 1), ("h", 2, 3, 2)}
