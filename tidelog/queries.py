"""The registered queries over the given tables, each with DuckDB's SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.iocs import NOT_DOMAINS, STARTERS
from .logframe import ADDRESS, AUDIT_LOG, EVENTS_LOG, LogFrame, audit_log, events_log
from .operators import adaptive, aggregates, casebook, cases, chains, claims, correlation, dashboards, detections, escalation, gaps, grounding, identity, incident, indicators, likeness, ranking, retrieval, search, sequences
from .plans import finalize, run
from .plans.questions import answer, extract_values, suggest, verified_zero
from .sources import merge_audit, parse_syslog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = make
    if sql is not None:
        ORACLES[name] = sql


def on_log(name: str, make: Callable[[LogFrame], DataFrame], sql: str | None) -> None:
    """A query over the events table as a log; ``sql`` may use the CTE ``log``."""
    _add(name, lambda spark, d: make(events_log(spark, d)), sql and f"WITH {EVENTS_LOG}{', ' if not sql.lstrip().upper().startswith('SELECT') else ''}{sql}")


def plan(name: str, spec: dict, where: str) -> None:
    """Rows that a plan selects."""
    on_log(name, lambda log: run(spec, log).select("pos", "event_type", "username"), f"SELECT pos, event_type, username FROM log WHERE {where}")


leaf = lambda op, field, **x: {"operation": op, "field": field, **x}
ERRORS = leaf("EXACT", "event_type", value=" Error ")

plan("exact", ERRORS, "event_type = 'error'")
plan("in_list", leaf("IN", "event_type", values=["click", "VIEW"]), "event_type IN ('click', 'view')")
plan("contains", leaf("CONTAINS", "message", value="code 7"), "message LIKE '%code 7%'")
plan("prefix", leaf("PREFIX", "source_ip", value="10.0.1."), "source_ip LIKE '10.0.1.%'")
plan("regex", leaf("REGEX", "message", value="from 10\\.0\\.[0-3]\\.\\d code (1|2)$"), "regexp_matches(message, 'from 10\\.0\\.[0-3]\\.\\d code (1|2)$')")
plan("range_num", leaf("RANGE", "code", min=10, max="20"), "TRY_CAST(code AS DOUBLE) BETWEEN 10 AND 20")
plan("time_range", {"operation": "TIME_RANGE", "start": "2024-01-05T00:00:00Z", "end": "2024-01-07T12:00:00+02:00"}, "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 10:00:00'")
plan("and_or_not", {"operation": "AND", "conditions": [{"operation": "OR", "conditions": [ERRORS, leaf("EXACT", "event_type", value="purchase")]}, {"operation": "NOT", "conditions": [leaf("EXACT", "severity", value="low")]}]}, "event_type IN ('error', 'purchase') AND NOT severity = 'low'")
on_log("plan_count", lambda log: run({"operation": "COUNT", "conditions": [ERRORS]}, log), "SELECT count(*) AS count FROM log WHERE event_type = 'error'")
on_log("distinct_values", lambda log: run({"operation": "DISTINCT", "field": "source_ip"}, log), "SELECT DISTINCT source_ip AS value FROM log")
on_log("plan_group", lambda log: run({"operation": "GROUP", "field": "username", "conditions": [ERRORS], "limit": 7}, log), "SELECT username AS value, count(*) AS count, count(*) OVER () AS n_groups FROM log WHERE event_type = 'error' GROUP BY username ORDER BY count DESC, value LIMIT 7")
on_log("sort_rows", lambda log: run({"operation": "SORT", "field": "code", "conditions": [ERRORS], "limit": 25}, log).select("pos", "code"), "SELECT pos, code FROM log WHERE event_type = 'error' ORDER BY code, pos LIMIT 25")
on_log("topk_rows", lambda log: run({"operation": "TOP_K", "field": "code", "numeric": True, "limit": 12}, log).select("pos", "code"), "SELECT pos, code FROM log ORDER BY CAST(code AS DOUBLE) DESC, pos LIMIT 12")

# Search
on_log("free_text", lambda log: search.free_text(log, "h77.example").select("pos"), "SELECT pos FROM log WHERE command LIKE '%h77.example%'")
on_log("token_search", lambda log: search.token_search(log, "purchase 42").select("pos"), "SELECT pos FROM log WHERE event_type = 'purchase' AND (code = '42' OR username = '42')")
on_log("term_rows", lambda log: search.term_rows(log, "xample").select("pos"), "SELECT pos FROM log WHERE command LIKE '%xample%'")
on_log("rows_with_field", lambda log: search.rows_with_field(log, "process").select("pos"), "SELECT pos FROM log WHERE process_name <> ''")
on_log("entity_rows", lambda log: search.entity_rows(log, "ip", "192.168.3.1").select("pos"), "SELECT pos FROM log WHERE source_ip = '192.168.3.1' OR destination_ip = '192.168.3.1'")
on_log("populated_fields", search.populated_fields, "SELECT 'event_type' AS field, count(*) AS n_rows FROM log" + "".join(f" UNION ALL SELECT '{f}', count(*) FILTER (WHERE {f} <> '') FROM log" for f in ("username", "source_ip", "destination_ip", "action", "severity", "code", "process_name", "command", "message")))
on_log("resolve_value", lambda log: search.resolve_value(log, "42"), "SELECT * FROM (SELECT 'username' AS field, CAST(count(*) FILTER (WHERE username = '42') AS BIGINT) AS n_rows, count(DISTINCT username) AS cardinality FROM log UNION ALL SELECT 'code', count(*) FILTER (WHERE code = '42'), count(DISTINCT code) FROM log) WHERE n_rows > 0")
on_log("score_rows", lambda log: search.score_rows(log, "purchase 42", {"severity": "high"}), "SELECT pos, CAST((CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) + (CASE WHEN code = '42' OR username = '42' THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'purchase 42') THEN 5 ELSE 0 END) + 0.25 * ((CASE WHEN contains(t, 'purchase') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, '42') THEN 1 ELSE 0 END)) AS DOUBLE) AS score FROM (SELECT *, concat_ws(' ', event_type, username, source_ip, destination_ip, action, severity, code, process_name, command, message) AS t FROM log WHERE severity = 'high') WHERE score > 0 ORDER BY score DESC, pos LIMIT 20")
on_log("page", lambda log: search.page(log, 2, 100).select("pos", "username"), "SELECT pos, username FROM log ORDER BY pos LIMIT 100 OFFSET 200")

# Aggregates
on_log("facet_topk", lambda log: aggregates.facet(log, "username", 10), "SELECT username AS value, count(*) AS count FROM log GROUP BY username ORDER BY count DESC, value LIMIT 10")
on_log("facets", lambda log: aggregates.facets(log, ["severity", "event_type", "process_name"], 3), "l AS (SELECT 'severity' AS field, severity AS value FROM log UNION ALL SELECT 'event_type', event_type FROM log UNION ALL SELECT 'process_name', process_name FROM log), c AS (SELECT field, value, count(*) AS count FROM l WHERE value <> '' GROUP BY ALL) SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS INTEGER) AS rank, value, count FROM c) WHERE rank <= 3")
on_log("distinct_count", lambda log: aggregates.distinct_count(log, "destination_ip"), "SELECT count(DISTINCT destination_ip) AS n_values FROM log")
on_log("time_histogram", lambda log: aggregates.time_histogram(log, 3600), "SELECT us // 3600000000 * 3600 AS bucket, count(*) AS count FROM log GROUP BY 1")
on_log("time_span", aggregates.time_span, "SELECT min(ts) AS first, max(ts) AS last, (max(us) - min(us)) / 1000000 AS seconds FROM log")
on_log("field_stats", lambda log: aggregates.field_statistics(log, "process_name"), "SELECT count(DISTINCT process_name) FILTER (WHERE process_name <> '') AS n_values, count(*) FILTER (WHERE process_name <> '') AS occurrences, round(count(*) FILTER (WHERE process_name <> '') / count(*), 4) AS ratio FROM log")
on_log("entity_summary", lambda log: aggregates.entity_summary(log, "ip"), "SELECT value, count(*) AS n_rows FROM (SELECT pos, source_ip AS value FROM log UNION SELECT pos, destination_ip FROM log) GROUP BY value")
on_log("auth_summary", aggregates.auth_summary, "SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS successful, count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS total FROM log")
on_log("coverage", lambda log: aggregates.coverage(log, log.value("severity") == "low"), "SELECT covered, total, round(covered / total, 4) AS ratio, CASE WHEN covered / total >= 0.99 THEN 'COMPLETE' WHEN covered / total >= 0.5 THEN 'TARGETED' WHEN covered > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS level FROM (SELECT count(*) FILTER (WHERE severity = 'low') AS covered, count(*) AS total FROM log)")
on_log("kpi_summary", aggregates.summary, "SELECT count(*) AS n_events, count(DISTINCT source_ip) AS n_ips, count(DISTINCT username) AS n_users, count(DISTINCT event_type) AS n_types, count(*) FILTER (WHERE action LIKE '%fail%') AS n_failed, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_severe FROM log")
on_log("events_by_hour", aggregates.by_hour, "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM log GROUP BY 1")
on_log("peak_hour", aggregates.peak_hour, "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM log GROUP BY 1 ORDER BY count DESC, hour LIMIT 1")
on_log("command_stats", aggregates.command_statistics, "SELECT process_name AS process, count(*) AS n_commands, count(DISTINCT command) AS n_distinct FROM log WHERE command <> '' GROUP BY 1")
on_log("candidates", aggregates.candidates, "SELECT source_ip, count(*) AS n_events, count(*) FILTER (WHERE action = 'failed_login') AS n_failed, count(*) FILTER (WHERE action = 'successful_login') AS n_successful, count(DISTINCT username) AS n_users, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_severe FROM log GROUP BY 1 ORDER BY n_events DESC, source_ip LIMIT 10")
on_log("dashboard", aggregates.dashboard, "SELECT count(*) FILTER (WHERE event_type = 'error') AS n_failed, round(100 * count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type IN ('error', 'purchase')), 2) AS failure_rate, count(DISTINCT source_ip) FILTER (WHERE event_type = 'error') AS n_failing_ips, count(DISTINCT destination_ip) AS n_destinations, count(*) FILTER (WHERE process_name = 'sudo') AS n_privileged, count(*) FILTER (WHERE command LIKE '%http://%') AS n_web_commands FROM log")
on_log("largest", lambda log: aggregates.largest(log, "code"), "SELECT max(TRY_CAST(code AS DOUBLE)) AS largest FROM log")
on_log("manifest", lambda log: aggregates.manifest(LogFrame(log.df, ("event_type", "username"))), """p AS (SELECT pos // 1000 AS part, pos, sha256('{"event_type":"' || event_type || '","username":"' || username || '"}') AS h FROM log) SELECT part, count(*) AS n_rows, sha256(string_agg(h, ',' ORDER BY pos)) AS sha256 FROM p GROUP BY part""")
_add("numeric_facets", lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")), "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL")

# Sequences
on_log("auth_sequence", sequences.success_after_failures, "w AS (SELECT source_ip, pos, ts, action, sum(CASE WHEN action = 'failed_login' THEN 1 ELSE 0 END) OVER x AS n, max(CASE WHEN action = 'failed_login' THEN ts END) OVER x AS lt FROM log WHERE action IN ('failed_login', 'successful_login') WINDOW x AS (PARTITION BY source_ip ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT source_ip, pos, CAST(n AS BIGINT) AS n_failures, (SELECT max(l.pos) FROM log l WHERE l.source_ip = w.source_ip AND l.ts = w.lt AND l.action = 'failed_login') AS last_failure FROM w WHERE action = 'successful_login' AND n >= 3 QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY ts, pos) = 1")
CHAINS = "c AS (SELECT f.pos AS failed, arg_min(s.pos, s.us) AS success, f.username, min(s.us) - f.us AS micros FROM log f JOIN log s ON f.username = s.username AND s.us > f.us AND f.action = 'failed_login' AND s.action = 'successful_login' GROUP BY f.pos, f.username, f.us HAVING min(s.us) - f.us <= 900000000)"
on_log("auth_chain_900s", sequences.auth_chains, f"{CHAINS} SELECT * FROM c")
on_log("rep_per_signature", lambda log: sequences.representatives(log.df.select("username", "event_type", "pos", "value"), ["username", "event_type"], [F.desc("value"), "pos"]), "SELECT username, event_type, pos, value FROM log QUALIFY row_number() OVER (PARTITION BY username, event_type ORDER BY value DESC, pos) = 1")
on_log("consecutive_runs", lambda log: sequences.consecutive_runs(log.df, "event_type", "pos"), "g AS (SELECT event_type, pos, pos - row_number() OVER (PARTITION BY event_type ORDER BY pos) AS i FROM log) SELECT event_type, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY event_type, i")
on_log("steps", sequences.steps, "SELECT * FROM (SELECT pos, lead(pos) OVER w AS next_pos, lead(us) OVER w - us AS micros FROM log WINDOW w AS (PARTITION BY username ORDER BY ts, pos)) WHERE next_pos IS NOT NULL")
on_log("timeline", lambda log: sequences.timeline(log, log.value("username") == "42").select("pos", "us"), "SELECT pos, us FROM log WHERE username = '42' ORDER BY ts, pos LIMIT 100")
on_log("first_and_last", lambda log: sequences.first_and_last(log, log.value("severity") == "critical"), "SELECT arg_min(pos, us) AS first, arg_max(pos, us) AS last FROM log WHERE severity = 'critical'")
on_log("sessions", sequences.sessions, "c AS (SELECT username AS entity, us, pos, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS cut FROM log WINDOW w AS (PARTITION BY username ORDER BY us, pos)), s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY entity ORDER BY us, pos) AS BIGINT) AS session FROM c) SELECT entity, session, count(*) AS n_events, min(us) AS first, max(us) AS last FROM s GROUP BY ALL")

# Detections
BURSTS = "b AS (SELECT source_ip, username, count(*) AS n_failures, 1 AS attempts, 'MEDIUM' AS severity, 55 AS score FROM log WHERE action = 'failed_login' GROUP BY 1, 2 HAVING count(*) >= 2)"
on_log("auth_burst", detections.bursts, f"{BURSTS} SELECT * FROM b")
on_log("scan_signal", detections.scans, "SELECT source_ip, count(DISTINCT destination_ip) AS n_destinations FROM log GROUP BY 1 HAVING count(DISTINCT destination_ip) >= 10")
on_log("privilege_rules", detections.privileges, "SELECT pos, 'PRIV-001' AS rule FROM log WHERE process_name = 'sudo'")
on_log("suspicious_commands", detections.commands, "SELECT pos FROM log WHERE command LIKE '%curl %'")
on_log("findings", detections.findings, f"{BURSTS}, {CHAINS}, f AS (SELECT 'AUTH-BURST-001' AS rule, source_ip || '|' || username AS subject, severity, score, n_failures AS n_evidence FROM b UNION ALL SELECT 'AUTH-CHAIN-002', failed || '|' || success, 'CRITICAL', 95, 2 FROM c UNION ALL SELECT 'PRIV-001', CAST(pos AS VARCHAR), 'MEDIUM', 45, 1 FROM log WHERE process_name = 'sudo' UNION ALL SELECT 'EXEC-001', CAST(pos AS VARCHAR), 'MEDIUM', 50, 1 FROM log WHERE command LIKE '%curl %' UNION ALL SELECT 'NET-001', source_ip, 'HIGH', 70, least(count(DISTINCT destination_ip), 100) FROM log GROUP BY source_ip HAVING count(DISTINCT destination_ip) >= 10) SELECT sha256(rule || '|' || subject) AS finding, *, CASE WHEN n_evidence >= 2 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM f")
on_log("event_score", lambda log: detections.event_scores(log).select("pos", "score", "priority", F.array_join("reasons", "; ").alias("reasons")), "k AS (SELECT source_ip, count(*) AS n FROM log WHERE action = 'failed_login' GROUP BY 1), s AS (SELECT pos, l.*, k.n FROM log l LEFT JOIN k USING (source_ip)), t AS (SELECT pos, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 10 ELSE 0 END + CASE WHEN event_type = 'error' THEN 25 + CASE WHEN n >= 10 THEN 20 ELSE 0 END ELSE 0 END + CASE WHEN event_type = 'click' THEN 35 ELSE 0 END + 3 AS score, concat_ws('; ', CASE WHEN severity <> 'low' THEN upper(severity[1]) || severity[2:] || ' log severity' END, CASE WHEN event_type = 'error' THEN 'Failed authentication attempt' END, CASE WHEN event_type = 'error' AND n >= 10 THEN 'Repeated failures from ' || source_ip || ' (' || n || ' attempts)' END, CASE WHEN event_type = 'click' THEN 'Download from the network; Path that anyone can write to' END, 'External/network destination present') AS reasons FROM s) SELECT pos, score, CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 35 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS priority, reasons FROM t")
on_log("attackers", incident.attackers, "f AS (SELECT username, source_ip, count(*) AS n_failures, max(pos) AS last_failure FROM log WHERE action = 'failed_login' GROUP BY 1, 2 HAVING count(*) >= 3) SELECT f.username, f.source_ip, n_failures, last_failure, count(s.pos) AS n_success, count(s.pos) > 0 AS has_success_after FROM f LEFT JOIN log s ON s.username = f.username AND s.action = 'successful_login' AND s.pos > last_failure GROUP BY ALL")
on_log("incident_profile", incident.profile, "f AS (SELECT username, source_ip, max(pos) AS last_failure FROM log WHERE action = 'failed_login' GROUP BY 1, 2 HAVING count(*) >= 3), a AS (SELECT username, source_ip FROM f WHERE EXISTS (SELECT 1 FROM log s WHERE s.username = f.username AND s.action = 'successful_login' AND s.pos > last_failure)), r AS (SELECT * FROM log WHERE username IN (SELECT username FROM a) OR source_ip IN (SELECT source_ip FROM a)) SELECT 'download' AS stage, count(*) AS n_rows, min(pos) AS first, max(pos) AS last, 'curl' AS tools FROM r WHERE event_type = 'click' HAVING count(*) > 0")
on_log("platform", incident.platform, "SELECT 0::BIGINT AS windows, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS linux, 'linux' AS platform FROM log")
on_log("log_profile", incident.classify, "SELECT 'endpoint' AS profile, 7 AS score FROM log LIMIT 1")
on_log("first_after_stage", lambda log: incident.first_after(log, "download"), "d AS (SELECT max(pos) AS p FROM log WHERE event_type = 'click') SELECT pos, command FROM log, d WHERE command <> '' AND pos > p ORDER BY pos LIMIT 1")

# Indicators
OCTETS = r"list_bool_and(list_transform(p[i:i + 3], lambda x: regexp_full_match(x, '[0-9]{1,3}') AND (x = '0' OR x[1] <> '0') AND coalesce(TRY_CAST(x AS INTEGER), 256) < 256))"
TEXT_IOCS = {
    # words and dots fall into parts; four of them that are numbers, with no further number beside them
    "ipv4": f"SELECT DISTINCT doc_id AS id, 'ipv4' AS kind, array_to_string(p[i:i + 3], '.') AS value FROM (SELECT doc_id, string_split(unnest(regexp_extract_all(text, '[0-9A-Za-z_.]+')), '.') AS p FROM documents), unnest(range(1, len(p) - 2)) AS u(i) WHERE {OCTETS} AND NOT regexp_matches(coalesce(p[i - 1], ''), '[0-9]$') AND NOT regexp_matches(coalesce(p[i + 4], ''), '^[0-9]')",
    "hash": "SELECT DISTINCT doc_id AS id, 'hash' AS kind, lower(v) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Fa-f0-9]+')) AS v FROM documents) WHERE length(v) IN (32, 40, 64)",
    "email": r"SELECT DISTINCT doc_id AS id, 'email' AS kind, lower(v) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS v FROM documents)",
}
for _name, _kind in {"ioc_ip": "ipv4", "ioc_hash": "hash", "ioc_email": "email"}.items():
    _add(_name, lambda spark, d, kind=_kind: indicators.extract(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", [kind]), TEXT_IOCS[_kind])
_add("ioc_url", lambda spark, d: indicators.extract(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "url", ["url"]), r"SELECT DISTINCT page_id AS id, 'url' AS kind, regexp_replace(v, '[.,;:)\]}]+$', '') AS value FROM (SELECT page_id, unnest(regexp_extract_all(url, '(?i)https?://[a-z0-9._~:/?#\[\]@!$&()*+,;=%-]+')) AS v FROM pages)".replace('""', '"'))
HOSTS = f"""SELECT DISTINCT page_id AS id, 'domain' AS kind, lower(run) AS value FROM (SELECT page_id, unnest(string_split_regex(url, '[^A-Za-z0-9.-]+')) AS run FROM pages) WHERE len(string_split(run, '.')) > 1
    AND list_bool_and(list_transform(string_split(run, '.'), lambda x: length(x) BETWEEN 1 AND 63 AND x[1] <> '-' AND x[-1] <> '-')) AND regexp_full_match(string_split(run, '.')[-1], '[A-Za-z]{{2,}}')
    AND lower(string_split(run, '.')[-1]) NOT IN ({', '.join(f"'{x}'" for x in NOT_DOMAINS)})"""
_add("ioc_domain", lambda spark, d: indicators.extract(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "url", ["domain"]), HOSTS)
STARTED = " OR ".join(f"contains(' ' || lower(command || ' ' || message) || ' ', '{x}')" for x in STARTERS)
on_log("ioc_counts", lambda log: indicators.counts(indicators.from_log(log)), f"SELECT 'ipv4' AS kind, count(DISTINCT ip) AS n_values, count(*) AS n_rows FROM (SELECT unnest(list_distinct([source_ip, destination_ip])) AS ip FROM log) UNION ALL SELECT 'username', count(DISTINCT username), count(*) FROM log UNION ALL SELECT 'process', count(DISTINCT process_name), count(*) FROM log WHERE process_name <> '' AND ({STARTED}) HAVING count(*) > 0 UNION ALL SELECT 'url', count(DISTINCT code), count(*) FROM log WHERE event_type = 'click' UNION ALL SELECT 'domain', count(DISTINCT code), count(*) FROM log WHERE event_type = 'click'")
on_log("ioc_summary", lambda log: indicators.summarize(indicators.extract(log.df, "pos", "destination_ip", ["ipv4"])), "SELECT 'ipv4' AS kind, destination_ip AS value, count(*) AS n_rows, min(pos) AS first, max(pos) AS last, true AS private, NULL::VARCHAR AS algorithm FROM log GROUP BY destination_ip")

# Correlation
SEEDS = "event_type = 'error' AND value >= 150"
on_log("related_pairs", lambda log: correlation.related(log, log.df.where(SEEDS), ["username", "source_ip"]), f"s AS (SELECT * FROM log WHERE {SEEDS}), p AS (SELECT s.pos AS seed, l.pos AS pos, abs(s.us - l.us) AS gap, s.username = l.username AS u, s.source_ip = l.source_ip AS i FROM s JOIN log l ON s.pos <> l.pos AND abs(s.us - l.us) <= 300000000), q AS (SELECT seed, pos, gap <= 300000000 AS n, u, i FROM p WHERE gap <= 300000000) SELECT seed, pos, concat_ws(', ', CASE WHEN n THEN 'near in time' END, CASE WHEN i THEN 'same source_ip' END, CASE WHEN u THEN 'same username' END) AS reasons, CAST(n AS INTEGER) + CAST(u AS INTEGER) + CAST(i AS INTEGER) AS score FROM q")
on_log("related_classes", lambda log: correlation.related_classes(log, log.df.where(SEEDS), ["username", "source_ip"]), f"s AS (SELECT * FROM log WHERE {SEEDS}), u AS (SELECT username AS v, count(*) AS n FROM log GROUP BY 1), i AS (SELECT source_ip AS v, count(*) AS n FROM log GROUP BY 1) SELECT pos AS seed, 'username' AS field, v AS value, n - 1 AS n_linked FROM s JOIN u ON username = v UNION ALL SELECT pos, 'source_ip', v, n - 1 FROM s JOIN i ON source_ip = v")
on_log("temporal_edges", lambda log: correlation.temporal_edges(log.df.select("pos", "us", "username"), 300, ["username"]), "SELECT a.pos AS source, b.pos AS target, b.us - a.us AS micros FROM log a JOIN log b ON a.username = b.username AND b.us - a.us BETWEEN 0 AND 300000000 AND (a.us < b.us OR a.pos < b.pos) AND a.pos <> b.pos")
on_log("shared_attr_pairs", lambda log: correlation.shared_attributes(log, log.df.where(SEEDS), ["username", "code"]), f"s AS (SELECT * FROM log WHERE {SEEDS}) SELECT a.pos AS source, b.pos AS target, concat_ws(', ', CASE WHEN a.code = b.code THEN 'code' END, CASE WHEN a.username = b.username THEN 'username' END) AS shared, CAST(a.code = b.code AS INTEGER) + CAST(a.username = b.username AS INTEGER) AS n FROM s a JOIN s b ON a.pos < b.pos AND (a.code = b.code OR a.username = b.username)")
on_log("attacker_scope", lambda log: correlation.scope(log, log.df.where("value >= 200").select("username", "source_ip")).select("pos"), "SELECT pos FROM log WHERE username IN (SELECT username FROM log WHERE value >= 200) OR source_ip IN (SELECT source_ip FROM log WHERE value >= 200)")
on_log("nearest_row", lambda log: correlation.nearest(log.df.where(SEEDS).select("pos", "us", "source_ip"), log.df.select("pos", "us", "source_ip"), ["source_ip"], 3600), f"SELECT s.pos AS anchor, arg_min(l.pos, struct_pack(g := abs(s.us - l.us), p := l.pos)) AS pos, min(abs(s.us - l.us)) AS micros FROM log s JOIN log l ON s.source_ip = l.source_ip AND s.pos <> l.pos AND abs(s.us - l.us) <= 3600000000 WHERE s.event_type = 'error' AND s.value >= 150 GROUP BY s.pos")
on_log("two_hop_bridge", lambda log: correlation.bridges(log.long(["username", "code"]), log.df.where(F.col("value") == log.df.agg(F.max("value")).scalar())), "s AS (SELECT * FROM log WHERE value = (SELECT max(value) FROM log)) SELECT DISTINCT a.pos AS start, b.pos AS via, 'code' AS field, c.pos AS \"end\" FROM s a JOIN log b ON a.username = b.username AND a.pos <> b.pos JOIN log c ON b.code = c.code AND c.pos <> b.pos AND c.pos <> a.pos UNION SELECT DISTINCT a.pos, b.pos, 'username', c.pos FROM s a JOIN log b ON a.code = b.code AND a.pos <> b.pos JOIN log c ON b.username = c.username AND c.pos <> b.pos AND c.pos <> a.pos")
on_log("anti_linked", lambda log: correlation.not_linked(log.df.where("event_type = 'error'").select("pos"), sequences.auth_chains(log).select(F.col("failed").alias("pos"))), f"{CHAINS} SELECT pos FROM log WHERE event_type = 'error' AND pos NOT IN (SELECT failed FROM c)")
CUSTOMER_SETS = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS group", "'day' AS field", "cast(date(ts) AS string) AS value").unionByName(spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS group", "'props' AS field", "props AS value"))
_add("case_similarity", lambda spark, d: likeness.overlaps(CUSTOMER_SETS(spark, d), {"day": 1, "props": 4}), "WITH s AS (SELECT DISTINCT user_id AS g, 'day' AS field, CAST(CAST(ts AS DATE) AS VARCHAR) AS value, 1 AS w FROM events UNION SELECT DISTINCT user_id, 'props', props, 4 FROM events) SELECT a.g AS a, b.g AS b, count(*) AS n_shared, CAST(sum(a.w) AS BIGINT) AS score FROM s a JOIN s b ON a.field = b.field AND a.value = b.value AND a.g < b.g GROUP BY 1, 2")
_add("shared_indicators", lambda spark, d: correlation.shared_indicators(CUSTOMER_SETS(spark, d)), "WITH s AS (SELECT user_id AS g, 'day' AS field, CAST(CAST(ts AS DATE) AS VARCHAR) AS value FROM events UNION ALL SELECT user_id, 'props', props FROM events), p AS (SELECT g, field, value, count(*) AS n FROM s GROUP BY ALL) SELECT field, value, count(*) AS n_groups, CAST(sum(least(n, 3)) AS BIGINT) AS score FROM p GROUP BY ALL HAVING count(*) > 1")
on_log("common_values", lambda log: correlation.common_values(log.on(log.df.where("event_type = 'error'")), log.on(log.df.where("event_type = 'purchase'")), ["username", "code"]), "e AS (SELECT * FROM log WHERE event_type = 'error'), p AS (SELECT * FROM log WHERE event_type = 'purchase') SELECT 'username' AS field, username AS value FROM e WHERE username IN (SELECT username FROM p) UNION SELECT 'code', code FROM e WHERE code IN (SELECT code FROM p)")

# Retrieval
_add("tfidf", lambda spark, d: retrieval.tfidf(spark.read.parquet(f"{d}/documents.parquet"), "license version apache", "doc_id", "text").select("id", F.round("score", 6).alias("score")), """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents), g AS (SELECT id, unnest(w) AS t FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w), tf AS (SELECT id, t, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT t, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY t), q AS (SELECT t, idf AS q FROM idf WHERE t IN ('license', 'version', 'apache', 'license version', 'version apache')), x AS (SELECT tf.id, tf.tf * idf.idf AS w, q.q FROM tf JOIN idf USING (t) LEFT JOIN q USING (t)), l AS (SELECT sqrt(sum(q * q)) AS l FROM q) SELECT id, round(sum(w * q) / (sqrt(sum(w * w)) * any_value(l)), 6) AS score FROM x, l GROUP BY id HAVING sum(w * q) IS NOT NULL""")
TERMS = "t AS (SELECT pos AS id, list_distinct(list_transform(list_filter(list_concat(w, flatten(list_transform(w, lambda x: regexp_split_to_array(x, '[_./:@+-]+')))), lambda x: length(x) >= 2), lambda x: CASE WHEN length(x) >= 7 AND x LIKE '%ing' THEN x[:-4] WHEN length(x) >= 6 AND (x LIKE '%ed' OR x LIKE '%es') THEN x[:-3] WHEN length(x) >= 5 AND x LIKE '%s' THEN x[:-2] ELSE x END)) AS terms FROM (SELECT pos, regexp_extract_all(lower(message), '[a-z0-9_./:@+-]{2,}') AS w FROM log))"
on_log("bm25", lambda log: retrieval.bm25(log.df, "purchase 42 clicks", "pos", "message").select("id", F.round("score", 6).alias("score")), f"{TERMS}, q AS (SELECT unnest(['purchase', '42', 'click']) AS t), d AS (SELECT q.t, count(*) AS df FROM t JOIN q ON list_contains(t.terms, q.t) GROUP BY q.t), s AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t) SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(terms) / mean))), 6) AS score FROM t JOIN d ON list_contains(t.terms, d.t), s GROUP BY id")
QUESTION = ["purchase", "user", "42"]
HYBRID = (
    rf"{TERMS}, m AS (SELECT pos AS id, regexp_extract_all(lower(message), '\b[a-z0-9][a-z0-9_.:/-]*\b') AS w, list_filter(regexp_split_to_array(lower(message), '\s+'), lambda x: x <> '') AS s FROM log), "
    f"q0 AS (SELECT -1 AS id, {QUESTION} AS w, {QUESTION} AS s), every AS (SELECT * FROM m UNION ALL SELECT * FROM q0), "
    "f AS (SELECT id, false AS gram, unnest(w) AS g FROM every UNION ALL SELECT id, false, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM every "
    "UNION ALL SELECT id, true, substring(p, i, k) FROM (SELECT id, ' ' || unnest(s) || ' ' AS p FROM every), unnest([3, 4, 5]) AS a(k), unnest(range(1, length(p) - k + 2)) AS b(i)), "
    "tf AS (SELECT id, gram, g, 1 + ln(count(*)) AS tf FROM f GROUP BY ALL), n AS (SELECT count(*) AS n FROM log), df AS (SELECT gram, g, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, n WHERE id >= 0 GROUP BY gram, g), "
    "x AS (SELECT id, gram, g, tf * idf AS w FROM tf JOIN df USING (gram, g)), l AS (SELECT id, gram, sqrt(sum(w * w)) AS l FROM x GROUP BY id, gram), "
    "c AS (SELECT x.id, sum(CASE WHEN x.gram THEN 0.35 ELSE 0.65 END * x.w * y.w / (l.l * k.l)) AS cosine FROM x JOIN x y ON y.id = -1 AND x.gram = y.gram AND x.g = y.g JOIN l ON l.id = x.id AND l.gram = x.gram JOIN l k ON k.id = -1 AND k.gram = x.gram WHERE x.id >= 0 GROUP BY x.id), "
    f"qt AS (SELECT unnest({QUESTION}) AS t), d AS (SELECT qt.t, count(*) AS df FROM t JOIN qt ON list_contains(t.terms, qt.t) GROUP BY qt.t), st AS (SELECT avg(len(terms)) AS mean FROM t), "
    "b AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(terms) / mean))) AS bm25 FROM t JOIN d ON list_contains(t.terms, d.t), st, n GROUP BY id), "
    f"p AS (SELECT t.id, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine, len(list_intersect(terms, {QUESTION})) / sqrt({len(QUESTION)}.0 * len(terms)) AS overlap, len(list_intersect(terms, {QUESTION})) / {len(QUESTION)}.0 AS exact FROM t LEFT JOIN b USING (id) LEFT JOIN c USING (id)), "
    "r AS (SELECT id, 0.5 * (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) + 0.3 * (cosine - min(cosine) OVER ()) / (max(cosine) OVER () - min(cosine) OVER ()) + 0.1 * overlap + 0.07 * exact AS score FROM p) "
    "SELECT id, round(score, 6) AS score FROM r WHERE score >= 0.45 * (SELECT max(score) FROM r) ORDER BY round(score, 9) DESC, id LIMIT 24"
)
on_log("hybrid_rank", lambda log: ranking.hybrid(log.df, " ".join(QUESTION), "pos", "message", fields=list(log.fields)).select("id", F.round("score", 6).alias("score")), HYBRID)
on_log("chunks", lambda log: retrieval.chunks(log.df, None), "SELECT pos, 't' || (us // 60000000) AS chunk FROM log")

# Questions and claims
on_log("qa_count", lambda log: answer("How many failed logins of user 42 were there between 2024-01-03 and 2024-01-20?", log), "SELECT count(*) AS count FROM log WHERE event_type = 'error' AND username = '42' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21'")
on_log("qa_top", lambda log: answer("Which users have the most critical failures?", log), "SELECT username AS value, count(*) AS count FROM log WHERE event_type = 'error' AND severity = 'critical' GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
on_log("qa_last_hours", lambda log: answer("How many successful logins happened in the last 36 hours?", log), "SELECT count(*) AS count FROM log WHERE event_type = 'purchase' AND us >= (SELECT max(us) FROM log) - 36 * 3600000000")
on_log("qa_first", lambda log: answer("What was the first critical failure?", log), "SELECT arg_min(pos, us) AS pos FROM log WHERE event_type = 'error' AND severity = 'critical'")
on_log("claim_counts", lambda log: grounding.counts(log.df.groupBy("username").agg((F.count("*") + F.expr("any_value(cast(username as bigint)) % 2")).alias("stated")).select(F.col("username").alias("claim"), F.col("username").alias("value"), "stated"), log.df, "username"), "SELECT username AS claim, username AS value, count(*) + CAST(username AS BIGINT) % 2 AS stated, count(*) AS actual, CASE WHEN CAST(username AS BIGINT) % 2 = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict FROM log GROUP BY username")
_claims = lambda log: log.df.select(F.col("pos").alias("claim"), F.expr("concat('It may be [EV-', pos, '] or [EV-', pos + 5, '] because of ', value, ' events')").alias("text"))
on_log("claim_citations", lambda log: grounding.citations(_claims(log), log.df.where("event_type = 'error'").select(F.expr("concat('EV-', pos)").alias("evidence_id"))), "c AS (SELECT pos AS claim, unnest([pos, pos + 5]) AS e FROM log) SELECT claim, 'EV-' || e AS cited, e IN (SELECT pos FROM log WHERE event_type = 'error') AS known FROM c")


def _told(log: LogFrame) -> DataFrame:
    """Three claims about each user: how many failures, that a success was seen, and where the user came from. Half of the numbers and addresses are false."""
    users = log.df.groupBy("username").agg(F.count_if(F.col("action") == "failed_login").alias("n"), F.min(F.when(F.col("action") == "failed_login", F.col("pos"))).alias("failed"), F.min("pos").alias("seen"))
    users = users.withColumn("u", F.expr("cast(username AS bigint)"))
    told = F.expr(f"""explode(array(
        struct('n' AS part, concat('There are ', n + u % 2, ' failed logins of user ', username, '.') AS text, failed AS at),
        struct('s' AS part, concat('A successful login was observed for user ', username, '.') AS text, seen AS at),
        struct('a' AS part, concat('User ', username, ' came from ', {ADDRESS.format('u + u % 2')}, '; it may be a scan.') AS text, seen AS at)))""")
    rows = users.select("username", told.alias("t"))
    return rows.select(F.concat_ws("-", "username", "t.part").alias("claim"), "t.text", F.lit(None).cast("string").alias("kind"), F.when(F.col("t.at").isNotNull(), F.array(F.concat(F.lit("EV-"), "t.at"))).alias("cited"))


def _judged(log: LogFrame) -> DataFrame:
    evidence = log.df.select(F.concat(F.lit("EV-"), "pos").alias("evidence_id"), F.concat_ws(" ", "action", "message").alias("text"))
    return claims.judge(_told(log), evidence).select("claim", "verdict", "status", F.array_join("missing", ", ").alias("missing"), "cited")


on_log("claims_judged", _judged, """u AS (SELECT username, CAST(username AS BIGINT) AS u, count(*) FILTER (WHERE action = 'failed_login') AS n, min(pos) AS seen, arg_min(action, pos) AS first FROM log GROUP BY username),
    t AS (SELECT username || '-n' AS claim, CASE WHEN n > 0 AND u % 2 = 0 THEN 'VERIFIED_FACT' ELSE 'UNSUPPORTED_CLAIM' END AS verdict, CASE WHEN n > 0 THEN '' ELSE 'theme:authentication, user:' || username END AS missing, CASE WHEN n > 0 THEN 1 ELSE 0 END AS cited FROM u
    UNION ALL SELECT username || '-s', CASE first WHEN 'successful_login' THEN 'VERIFIED_FACT' WHEN 'failed_login' THEN 'CONTRADICTED_CLAIM' ELSE 'UNSUPPORTED_CLAIM' END, CASE first WHEN 'successful_login' THEN '' WHEN 'failed_login' THEN 'outcome:success' ELSE 'outcome:success, theme:authentication' END, 1 FROM u
    UNION ALL SELECT username || '-a', CASE WHEN u % 2 = 0 THEN 'GROUNDED_INTERPRETATION' ELSE 'UNSUPPORTED_CLAIM' END, CASE WHEN u % 2 = 0 THEN '' ELSE 'ip:10.' || ((u + 1) // 4096 % 256) || '.' || ((u + 1) // 16 % 256) || '.' || ((u + 1) % 16 + (u + 1) // 1048576 % 16 * 16) END, 1 FROM u)
    SELECT claim, verdict, CASE verdict WHEN 'UNSUPPORTED_CLAIM' THEN 'REJECTED' WHEN 'CONTRADICTED_CLAIM' THEN 'REJECTED_CONTRADICTED' WHEN 'VERIFIED_FACT' THEN 'ACCEPTED' ELSE 'ACCEPTED_AS_INTERPRETATION' END AS status, missing, CAST(cited AS BIGINT) AS cited FROM t""")  # fmt: skip
on_log("claim_kinds", lambda log: grounding.classify(log.df.select(F.col("pos").alias("claim"), F.expr("CASE event_type WHEN 'error' THEN concat(code, ' failures were seen') WHEN 'click' THEN 'It was caused by a user' WHEN 'view' THEN 'This suggests nothing' ELSE message END").alias("text"))), "SELECT pos AS claim, CASE event_type WHEN 'error' THEN 'COUNT' WHEN 'click' THEN 'CAUSAL' WHEN 'view' THEN 'HEDGED' ELSE 'OBSERVATION' END AS kind FROM log")

# Evidence and cases
_store = lambda log, rule: log.df.where(rule).selectExpr("format_string('EV-%06d', pos + 1) AS evidence_id", "event_type AS file", "pos AS line", "us AS timestamp", "'NEW' AS status", "severity AS priority")
on_log("evidence_upsert", lambda log: cases.add_evidence(_store(log, "event_type = 'view'"), _store(log, "event_type in ('view', 'error')")).select("evidence_id", "line"), "o AS (SELECT pos, event_type, us FROM log WHERE event_type = 'view'), n AS (SELECT pos, row_number() OVER (ORDER BY event_type, pos, us) + (SELECT max(pos) + 1 FROM o) AS k FROM log WHERE event_type = 'error') SELECT printf('EV-%06d', pos + 1) AS evidence_id, pos AS line FROM o UNION ALL SELECT printf('EV-%06d', k), pos FROM n")
_cases = lambda log: log.df.where("severity = 'critical'").groupBy(F.col("username").alias("case_id")).agg(F.transform(F.array_sort(F.collect_set("pos")), lambda p: F.format_string("EV-%06d", p + 1)).alias("evidence_ids"))
on_log("case_evidence", lambda log: cases.evidence_of(_cases(log), _store(log, "event_type = 'error'")).select("case_id", "line"), "SELECT username AS case_id, pos AS line FROM log WHERE severity = 'critical' AND event_type = 'error'")
on_log("case_lineage", lambda log: cases.lineage(_cases(log), _store(log, "event_type = 'error'")), "SELECT username AS case_id, CAST(row_number() OVER (PARTITION BY username ORDER BY pos) - 1 AS INTEGER) AS place, printf('EV-%06d', pos + 1) AS evidence_id, event_type = 'error' AS known FROM log WHERE severity = 'critical'")
_inside = lambda log: log.df.where("severity = 'critical'").withColumn("case_id", F.col("username"))
on_log("case_summary", lambda log: cases.case_summary(_inside(log)), "SELECT username AS case_id, count(*) AS n, count(*) AS n_severe, 1::BIGINT AS n_users, count(DISTINCT source_ip) AS n_ips, min(us) AS first, max(us) AS last FROM log WHERE severity = 'critical' GROUP BY username")
GAPS = "e AS (SELECT * FROM log WHERE severity = 'critical'), g AS (SELECT username AS case_id, count(*) FILTER (WHERE event_type = 'error') = 0 AS a, count(*) FILTER (WHERE event_type = 'purchase') = 0 AS b, count(*) FILTER (WHERE command <> '') = 0 AS c FROM e GROUP BY username)"
on_log("case_gaps", lambda log: cases.gaps(_inside(log)), f"{GAPS} SELECT case_id, 'no failed authentication' AS gap FROM g WHERE a UNION ALL SELECT case_id, 'no successful authentication' FROM g WHERE b UNION ALL SELECT case_id, 'no command' FROM g WHERE c UNION ALL SELECT case_id, 'one source only' FROM g")
on_log("case_decision", lambda log: cases.decisions(_inside(log)), f"{GAPS} SELECT case_id, 1 + CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) AS n_gaps, CASE WHEN a OR b OR c THEN 'investigate' ELSE 'escalate' END AS decision FROM g")
on_log("graph_edges", lambda log: cases.graph(log, log.df.where(SEEDS))[1], f"s AS (SELECT * FROM log WHERE {SEEDS}) SELECT 'event:' || pos AS source, 'user:' || username AS target, 'user' AS type FROM s UNION ALL SELECT 'event:' || pos, 'ip:' || source_ip, 'ip' FROM s UNION ALL SELECT * FROM (SELECT 'event:' || pos, 'event:' || lead(pos) OVER (PARTITION BY username ORDER BY ts, pos) AS t, 'next' FROM s) WHERE t IS NOT NULL")
on_log("graph_nodes", lambda log: cases.graph(log, log.df.where(SEEDS))[0], f"s AS (SELECT * FROM log WHERE {SEEDS}) SELECT 'event:' || pos AS id, 'event' AS type, message AS label FROM s UNION ALL SELECT DISTINCT 'user:' || username, 'user', username FROM s UNION ALL SELECT DISTINCT 'ip:' || source_ip, 'ip', source_ip FROM s")

# Sources: lines that Spark derives from the events are parsed again
LINES = lambda log: log.df.selectExpr("pos AS line", "concat(date_format(ts, 'MMM dd HH:mm:ss'), ' host', pos % 5, ' sshd[', 1000 + pos % 77, ']: ', CASE event_type WHEN 'error' THEN 'Failed' ELSE 'Accepted' END, ' password for user', username, ' from ', source_ip, ' port 22') AS value")
on_log("syslog_parse", lambda log: parse_syslog(LINES(log), 2024).select("line", F.unix_seconds("ts").alias("seconds"), "host", "process_name", "pid", "username", "source_ip", "action", "severity"), "SELECT pos AS line, us // 1000000 AS seconds, 'host' || (pos % 5) AS host, 'sshd' AS process_name, CAST(1000 + pos % 77 AS VARCHAR) AS pid, 'user' || username AS username, source_ip, CASE event_type WHEN 'error' THEN 'failed_login' ELSE 'successful_login' END AS action, CASE event_type WHEN 'error' THEN 'high' ELSE 'low' END AS severity FROM log")
AUDIT_LINES = lambda log: log.df.selectExpr("pos AS line", "CASE WHEN pos % 2 = 0 THEN concat('type=SYSCALL msg=audit(', us div 1000000, '.123:', pos div 4, '): pid=', 100 + pos, ' auid=', username, ' comm=\"', event_type, '\" a0=zz') ELSE concat('type=EXECVE msg=audit(', us div 1000000, '.123:', pos div 4, '): argc=2 a1=\"-o\" a0=\"', event_type, '\" a10=last a2=', hex(concat('file name ', code))) END AS value")
on_log("audit_merge", lambda log: merge_audit(parse_syslog(AUDIT_LINES(log), 2024)).where("audit_type = 'EXECVE'").selectExpr("line", "command", "process_name", "attrs['auid'] AS auid", "attrs['a0'] AS a0"), "SELECT e.pos AS line, e.event_type || ' -o file name ' || e.code || ' last' AS command, s.event_type AS process_name, s.username AS auid, e.event_type AS a0 FROM log e LEFT JOIN log s ON s.pos = least(e.pos // 4 * 4 + 2, (SELECT max(pos) // 2 * 2 FROM log)) WHERE e.pos % 2 = 1")
_add("json_field", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("count")), "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS count FROM events GROUP BY 1")
on_log("evidence_reattach", lambda log: cases.reattach(log.df.selectExpr("event_type AS file", "pos AS line", "us AS timestamp"), _store(log, "event_type = 'error'")).select("line", "evidence_id"), "SELECT pos AS line, CASE WHEN event_type = 'error' THEN printf('EV-%06d', pos + 1) END AS evidence_id FROM log")
on_log("evidence_context", lambda log: retrieval.context(log, "purchase of user", ["10.0.2.1 "], {"severity": "critical"}), "SELECT pos, score FROM (SELECT pos, CAST(contains(t, 'purchase') AS INTEGER) + CAST(contains(t, 'user') AS INTEGER) + 4 * CAST(contains(t, '10.0.2.1 ') AS INTEGER) + 6 * CAST(severity = 'critical' AS INTEGER) AS score FROM (SELECT *, concat_ws(' ', event_type, username, source_ip, destination_ip, action, severity, code, process_name, command, message) AS t FROM log)) WHERE score > 0 ORDER BY score DESC, pos LIMIT 40")
on_log("chunk_expansion", lambda log: retrieval.with_chunks(log.df.where("value >= 200").select("pos"), retrieval.chunks(log.df, None, 3600)), "SELECT pos FROM log WHERE us // 3600000000 IN (SELECT us // 3600000000 FROM log WHERE value >= 200)")
on_log("related_terms", lambda log: retrieval.related_terms(log, log.df.where("value >= 150"), ["username", "event_type"], 3), "h AS (SELECT * FROM log WHERE value >= 150), c AS (SELECT 'username' AS field, username AS value, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM h GROUP BY 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 3")
on_log("qa_values", lambda log: extract_values("List the destinations of critical failures", log, "username"), "SELECT username AS value, count(*) AS count FROM log WHERE event_type = 'error' AND severity = 'critical' GROUP BY 1")
on_log("qa_verified_zero", lambda log: verified_zero("How many critical failed logins of user 9999 were there?", log), "SELECT 'action' AS field, 'failed_login' AS value, count(*) FILTER (WHERE event_type = 'error') AS n_rows FROM log UNION ALL SELECT 'severity', 'critical', count(*) FILTER (WHERE severity = 'critical') FROM log UNION ALL SELECT 'username', '9999', count(*) FILTER (WHERE username = '9999') FROM log")
on_log("qa_suggestions", suggest, "c AS (SELECT 'How many failed logins of user ' || username || ' were there?' AS question, username AS v, 'u' AS f, count(*) AS n FROM log GROUP BY username UNION ALL SELECT 'Show the timeline of ' || source_ip, source_ip, 'i', count(*) FROM log GROUP BY source_ip UNION ALL SELECT 'Which users have the most events of ' || action || '?', action, 'a', count(*) FROM log GROUP BY action) SELECT question FROM c QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, v) <= 3")

_add("case_likeness", lambda spark, d: likeness.similar(CUSTOMER_SETS(spark, d), {"day": 1, "props": 4}, 150)[0], """WITH s AS (SELECT DISTINCT user_id AS g, 'day' AS field, CAST(CAST(ts AS DATE) AS VARCHAR) AS value, 1 AS w FROM events UNION SELECT DISTINCT user_id, 'props', props, 4 FROM events),
    k AS (SELECT g, string_agg(field || value, '|' ORDER BY field, value) AS k FROM s GROUP BY g), r AS (SELECT s.* FROM s WHERE g IN (SELECT min(g) FROM k GROUP BY k))
    SELECT a.g AS a, b.g AS b, count(*) AS n_shared, CAST(sum(a.w) AS BIGINT) AS score FROM r a JOIN r b ON a.field = b.field AND a.value = b.value AND a.g < b.g GROUP BY 1, 2 HAVING sum(a.w) >= 150""")
# Cases of all users: what their evidence amounts to
_book = lambda log: log.df.select(F.col("username").alias("case_id"), F.col("pos").alias("evidence_id"), "action", "event_type", "message", "command", "source_ip", "username", "process_name")
BOOK = """m AS (SELECT username AS case_id, pos, action = 'failed_login' AS failed, action IN ('failed_login', 'successful_login') AS login, command <> '' AS ran, source_ip, process_name FROM log),
    s AS (SELECT case_id, CAST(count(*) > 1 AS BIGINT) * 2 + CAST(count(*) FILTER (WHERE process_name = 'curl') > 1 AS BIGINT) + CAST(count(*) FILTER (WHERE process_name = 'sudo') > 1 AS BIGINT) AS n_shared FROM m GROUP BY case_id),
    b AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE login) AS n_logins, count(*) FILTER (WHERE ran) AS n_runs, any_value(n_shared) AS n_shared FROM m JOIN s USING (case_id) GROUP BY case_id)"""
on_log("case_assessment", lambda log: casebook.assess(_book(log)), f"{BOOK} SELECT *, n_failed AS attempts, CAST(1 AS BIGINT) AS n_users, CAST(1 AS BIGINT) AS n_ips, CASE WHEN n_failed > 1 THEN 'Repeated authentication failures.' WHEN n_failed = 1 THEN 'An authentication failure.' WHEN n_logins > 0 AND n_runs > 0 THEN 'Authentication and commands in one case.' WHEN n_runs > 0 THEN 'Commands.' ELSE 'Activity for review.' END AS summary FROM b")
on_log("case_findings", lambda log: casebook.findings(_book(log)), f"{BOOK}, f AS (SELECT case_id, 1 AS k, 'OBSERVED' AS classification, n_failed AS n_evidence FROM b WHERE n_failed > 0 UNION ALL SELECT case_id, 2, 'CORRELATION', n_shared FROM b WHERE n_shared > 0 UNION ALL SELECT case_id, 3, 'LIMITATION', n FROM b) SELECT case_id, printf('F-%03d', row_number() OVER (PARTITION BY case_id ORDER BY k)) AS finding, classification, CASE classification WHEN 'CORRELATION' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, n_evidence FROM f")
on_log("case_support", lambda log: casebook.support(_book(log)), f"{BOOK} SELECT case_id, 'OBSERVED' AS classification, pos AS evidence_id FROM m WHERE failed UNION ALL SELECT case_id, 'LIMITATION', pos FROM m UNION ALL SELECT m.case_id, 'CORRELATION', pos FROM m JOIN s USING (case_id) WHERE n_shared > 0")

# Audit identities
ACTOR = "fails AS (SELECT username, source_ip, count(*) AS n FROM log WHERE action = 'failed_login' GROUP BY 1, 2 HAVING count(*) >= 3), actor AS (SELECT username, source_ip FROM fails ORDER BY n DESC, username, source_ip LIMIT 1)"
LEARNT = f"WITH RECURSIVE {EVENTS_LOG}, {AUDIT_LOG}, {ACTOR}, facts AS (SELECT DISTINCT username, source_ip, uid, euid, auid FROM audit), ids AS (SELECT unnest([f.uid, f.auid]) AS identity FROM facts f, actor a WHERE f.username = a.username OR f.source_ip = a.source_ip UNION SELECT unnest([f.uid, f.auid]) FROM facts f JOIN ids i ON i.identity IN (f.uid, f.euid, f.auid) AND i.identity NOT IN ('0', '-1', '4294967295')), identities AS (SELECT identity FROM ids WHERE identity NOT IN ('0', '-1', '4294967295'))"


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_log(spark, sf_dir)
    actor = identity.main_actor(log)
    return identity.scope(log, actor, identity.learn(log, actor))


_add("attacker_identities", lambda spark, d: identity.learn(log := audit_log(spark, d), identity.main_actor(log)), f"{LEARNT} SELECT identity FROM identities")
_add("attacker_scope", _scope, f"{LEARNT}, r AS (SELECT pos, CASE WHEN auid IN (SELECT identity FROM identities) THEN 'auid' END AS a, CASE WHEN euid IN (SELECT identity FROM identities) THEN 'euid' END AS e, CASE WHEN source_ip IN (SELECT source_ip FROM actor) THEN 'source_ip' END AS s, CASE WHEN uid IN (SELECT identity FROM identities) THEN 'uid' END AS u, CASE WHEN username IN (SELECT username FROM actor) THEN 'username' END AS n FROM audit) SELECT pos, concat_ws(',', a, e, s, u, n) AS reasons FROM r WHERE coalesce(a, e, s, u, n) IS NOT NULL")



def _story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the main actor did. In this log views run as root and commands that fetch stand for attempts."""
    log = audit_log(spark, sf_dir)
    return escalation.story(log.on(log.df.join(_scope(spark, sf_dir).select("pos"), "pos", "left_semi")), ("curl",), ("/etc",), "euid")


_add("actor_story", _story, f"""{LEARNT}, v AS (SELECT * FROM audit WHERE username IN (SELECT username FROM actor) OR source_ip IN (SELECT source_ip FROM actor) OR uid IN (SELECT identity FROM identities) OR euid IN (SELECT identity FROM identities) OR auid IN (SELECT identity FROM identities)),
    a AS (SELECT command, min(pos) AS pos, count(*) AS n FROM v WHERE command LIKE 'curl %' GROUP BY command),
    r AS (SELECT command, pid, min(pos) AS pos, count(*) AS n FROM v WHERE command <> '' AND euid = '0' AND auid <> '4294967295' GROUP BY command, pid)
    SELECT 'attempt' AS part, 'curl' AS what, command AS detail, pos, n FROM a UNION ALL SELECT 'root', command, pid, pos, n FROM r
    UNION ALL (SELECT 'root shell', command, '', pos, 1 FROM r WHERE pos > (SELECT min(pos) FROM a) ORDER BY pos LIMIT 1)
    UNION ALL SELECT 'download', 'x', split_part(command, ' ', 4), min(pos), count(*) FROM v WHERE command LIKE 'curl %' GROUP BY ALL
    UNION ALL SELECT 'root read', split_part(command, ' ', 2), command, min(pos), count(*) FROM v WHERE command LIKE 'cat %' GROUP BY ALL""")

# Gaps beside the evidence of great errors
GAP_FIELDS = ["username", "source_ip", "process_name", "pid", "ppid", "auid", "uid", "audit_serial", "audit_session"]


def _gap_sql(candidate: str, direct: str, fills: int, bridge: bool) -> str:
    shares = lambda t, f: f"{t}.{f} <> '' AND {t}.{f} IN (SELECT {f} FROM anchors)"
    points = " + ".join(f"CASE WHEN {f} THEN {gaps.POINTS[f]} ELSE 0 END" for f in GAP_FIELDS)
    names = ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in sorted(GAP_FIELDS))
    strong = " OR ".join(shares("n", f) for f in gaps.STRONG)
    over = " OR ".join(f"c.{f} IN (SELECT {f} FROM bridges)" for f in gaps.STRONG) if bridge else "false"
    return (
        f"WITH {EVENTS_LOG}, {AUDIT_LOG}, anchors AS (SELECT * FROM audit WHERE {SEEDS}), others AS (SELECT * FROM audit WHERE NOT ({SEEDS})), "
        "lo AS (SELECT o.pos, o.us - a.us AS d FROM others o ASOF LEFT JOIN anchors a ON o.us >= a.us), hi AS (SELECT o.pos, a.us - o.us AS d FROM others o ASOF LEFT JOIN anchors a ON o.us <= a.us), "
        f"n AS (SELECT o.*, least(lo.d, hi.d) AS micros FROM others o JOIN lo USING (pos) JOIN hi USING (pos) WHERE least(lo.d, hi.d) <= {gaps.WINDOW_S} * 1000000), "
        f"bridges AS (SELECT * FROM n WHERE {strong}), "
        f"c AS (SELECT c.pos, c.micros, {', '.join(f'({shares("c", f)}) AS {f}' for f in GAP_FIELDS)}, ({over}) AS over FROM n c WHERE {candidate}), "
        f"d AS (SELECT *, ({direct}) AS direct FROM c) "
        f"SELECT pos, CAST({gaps.BASE + gaps.NEAR + fills} + {points} + CASE WHEN NOT direct AND over THEN {gaps.BRIDGE} ELSE 0 END AS BIGINT) AS score, concat_ws(',', {names}) AS shared, NOT direct AND over AS bridged, micros FROM d WHERE direct OR over"
    )


def _gap(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: gaps.search(log := audit_log(spark, d), log.df.where(SEEDS).select("pos"), name)


LOGIN_ROWS = "action IN ('failed_login', 'successful_login')"
GAP_SOURCE = _gap_sql(LOGIN_ROWS, "username", gaps.FILLS, False)
_add("gap_login", _gap("login"), _gap_sql("action = 'successful_login'", "true", 0, False))
_add("gap_source", _gap("source"), GAP_SOURCE)
_add("gap_process", _gap("process"), _gap_sql(f"({LOGIN_ROWS} OR process_name = 'sudo')", "process_name OR source_ip OR " + " OR ".join(gaps.STRONG), gaps.FILLS, True))
_add("gap_representatives", lambda spark, d: gaps.representatives(log := audit_log(spark, d), gaps.search(log, log.df.where(SEEDS).select("pos"), "source"), ["source_ip", "username", "action"]), f"SELECT pos, score, micros, n AS n_alike FROM (SELECT f.*, count(*) OVER w AS n, row_number() OVER (w ORDER BY score DESC, micros, f.pos) AS r FROM ({GAP_SOURCE}) f JOIN (WITH {EVENTS_LOG} SELECT pos, source_ip, username, action FROM log) l ON l.pos = f.pos WINDOW w AS (PARTITION BY source_ip, username, action)) WHERE r = 1 ORDER BY score DESC, micros, pos LIMIT {gaps.MOST}")

# Pages, budgets, chains and dashboards
on_log("finalized_page", lambda log: finalize(ERRORS | {"limit": 50}, log).select("pos", "count", "returned_count", "truncated", "exhaustive"), "e AS (SELECT pos, count(*) OVER () AS n FROM log WHERE event_type = 'error') SELECT pos, n AS count, least(n, 50) AS returned_count, n > 50 AS truncated, n <= 50 AS exhaustive FROM e ORDER BY pos LIMIT 50")
on_log("adaptive_context", lambda log: adaptive.retrieve(log, "view by user 42 from", 200), """t AS (SELECT *, concat_ws(' ', 'event_type=' || event_type, 'username=' || username, 'source_ip=' || source_ip, 'destination_ip=' || destination_ip, 'action=' || action, 'severity=' || severity, 'code=' || code,
    'process_name=' || nullif(process_name, ''), 'command=' || nullif(command, ''), 'message=' || message) AS t FROM log),
    s AS (SELECT *, CAST(40 * contains(t, 'view by user 42 from')::INT + 11 * contains(t, 'view')::INT + 11 * contains(t, 'user')::INT + 4 * contains(t, '42')::INT + 9 AS DOUBLE) AS score FROM t),
    n AS (SELECT * FROM s WHERE score >= greatest(8, 0.81 * (SELECT max(score) FROM s)) ORDER BY score DESC, pos LIMIT 200), k AS (SELECT count(*) AS k FROM n), a AS (SELECT * FROM n ORDER BY score DESC, pos LIMIT 8),
    r AS (SELECT pos, greatest(1, score * 0.45) AS score, row_number() OVER (ORDER BY pos) AS i FROM s WHERE pos NOT IN (SELECT pos FROM n) AND (source_ip IN (SELECT source_ip FROM a) OR destination_ip IN (SELECT destination_ip FROM a) OR username IN (SELECT username FROM a) OR process_name IN (SELECT process_name FROM a WHERE process_name <> '')))
    SELECT pos, score, 0 AS hop FROM n UNION ALL SELECT pos, score, 1 FROM r, k WHERE k > 1 AND i <= 200 - k""")
on_log("qa_cause", lambda log: answer("Did the failed logins from 10.0.2.1 cause the clicks?", log), """f AS (SELECT * FROM log WHERE action = 'failed_login' AND source_ip = '10.0.2.1'), g AS (SELECT * FROM log WHERE action = 'click'),
    a AS (SELECT 'username' AS field, username AS value FROM f UNION ALL SELECT 'source_ip', source_ip FROM f UNION ALL SELECT 'process_name', process_name FROM f WHERE process_name <> ''),
    b AS (SELECT 'username' AS field, username AS value FROM g UNION ALL SELECT 'source_ip', source_ip FROM g UNION ALL SELECT 'process_name', process_name FROM g WHERE process_name <> ''),
    c AS (SELECT field, value, x.n + y.n AS n, row_number() OVER (PARTITION BY field ORDER BY value) AS r FROM (SELECT field, value, count(*) AS n FROM a GROUP BY ALL) x JOIN (SELECT field, value, count(*) AS n FROM b GROUP BY ALL) y USING (field, value))
    SELECT 'first' AS part, 'action' AS field, 'failed_login' AS value, count(*) AS n FROM f UNION ALL SELECT 'second', 'action', 'click', count(*) FROM g UNION ALL SELECT 'shared', field, value, n FROM c WHERE r <= 3""")
on_log("qa_proof", lambda log: answer("Do the logs prove that user 42 was compromised?", log, earlier=["How many events came from 10.0.2.1?"]), """o AS (SELECT action, count(*) AS n FROM log WHERE username = '42' GROUP BY action ORDER BY n DESC, action LIMIT 6)
    SELECT 'matching' AS part, '' AS field, '' AS value, count(*) FILTER (WHERE username = '42') AS n FROM log UNION ALL SELECT 'earlier', 'source_ip', '10.0.2.1', count(*) FILTER (WHERE source_ip = '10.0.2.1') FROM log UNION ALL SELECT 'outcome', 'action', action, n FROM o""")
on_log("qa_earlier", lambda log: answer("How many failures has this user?", log, earlier=["Show user 7", "How many events has user 42?"]), "SELECT count(*) FILTER (WHERE username = '42' AND action = 'failed_login') AS count FROM log")
on_log("context_budget", lambda log: retrieval.within_budget(log.df.select("pos", "value", "message"), F.col("message"), 20_000, [F.desc("value"), F.col("pos")], 4_000).select("pos", "tokens", "before", "part"), "t AS (SELECT pos, CAST(ceil(length(message) / 4) AS BIGINT) AS tokens, value FROM log), s AS (SELECT pos, tokens, CAST(sum(tokens) OVER (ORDER BY value DESC, pos) - tokens AS BIGINT) AS before FROM t) SELECT *, before // 4000 AS part FROM s WHERE before + tokens <= 20000")
on_log("investigation_chain", lambda log: chains.chain(log, log.df.where(SEEDS)), f"s AS (SELECT *, row_number() OVER (ORDER BY us, pos) AS step FROM log WHERE {SEEDS}), n AS (SELECT s.*, lead(us) OVER w AS us2, lead(source_ip) OVER w AS i2, lead(username) OVER w AS u2, lead(process_name) OVER w AS p2 FROM s WINDOW w AS (ORDER BY step)) SELECT step, pos, concat_ws('; ', 'event_type=' || event_type, 'source_ip=' || source_ip, 'username=' || username, CASE WHEN process_name <> '' THEN 'process_name=' || process_name END, 'action=' || action) AS context, concat_ws(',', CASE WHEN source_ip = i2 THEN 'source_ip' END, CASE WHEN username = u2 THEN 'username' END, CASE WHEN process_name <> '' AND process_name = p2 THEN 'process_name' END, CASE WHEN us2 - us <= 300000000 THEN 'temporal' END) AS links FROM n")
GRAPH = f"s AS (SELECT * FROM log WHERE {SEEDS}), e0 AS (SELECT 'event:' || pos AS source, 'user:' || username AS target FROM s UNION ALL SELECT 'event:' || pos, 'ip:' || source_ip FROM s UNION ALL SELECT * FROM (SELECT 'event:' || pos, 'event:' || lead(pos) OVER (PARTITION BY username ORDER BY ts, pos) AS t FROM s) WHERE t IS NOT NULL), e AS (SELECT source, target FROM e0 UNION SELECT target, source FROM e0), r AS (SELECT 'event:' || min(pos) AS node, 0 AS depth FROM s UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node WHERE r.depth < 4), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"
_add("graph_reach", lambda spark, d: chains.reach(cases.graph(log := events_log(spark, d), log.df.where(SEEDS))[1], log.df.where(SEEDS).agg(F.concat(F.lit("event:"), F.min("pos").cast("string")).alias("node")), 4), f"WITH RECURSIVE {EVENTS_LOG}, {GRAPH} SELECT d.node, CAST(d.depth AS INTEGER) AS depth, (SELECT min(p.node) FROM d p JOIN e ON e.source = p.node WHERE e.target = d.node AND p.depth = d.depth - 1) AS parent FROM d")
for _kind in dashboards.FACETS:
    _facets = [f for f in dashboards.FACETS[_kind] if f in ("hour", "event_type", "username", "source_ip", "destination_ip", "action", "severity", "process_name", "command")]
    _rows = " UNION ALL ".join([f"SELECT '{f}' AS facet, {'strftime(ts, $$%H$$)' if f == 'hour' else f'lower(trim({f}))'} AS value, * EXCLUDE (value) FROM log" for f in _facets] + ["SELECT 'all', NULL, * EXCLUDE (value) FROM log"])
    on_log(f"dashboard_{_kind}", lambda log, kind=_kind: dashboards.dashboard(log, kind), f"x AS ({_rows}), g AS (SELECT facet, value, count(*) AS n_rows, count(*) FILTER (WHERE action LIKE '%fail%') AS n_failed, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_severe, min(pos) AS first, max(pos) AS last FROM x WHERE facet = 'all' OR value <> '' GROUP BY facet, value) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n_rows DESC, value) <= 10")

on_log("qa_count_after", lambda log: answer("How many successful logins of user 42 were there after the failures?", log), "f AS (SELECT us, pos FROM log WHERE username = '42' AND action = 'failed_login' ORDER BY us DESC, pos DESC LIMIT 1) SELECT count(*) AS count FROM log l, f WHERE username = '42' AND action = 'successful_login' AND (l.us, l.pos) > (f.us, f.pos)")
