"""Detections, and scores of single events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..logframe import LogFrame
from .sequences import auth_chains

#: Command parts of interest, and what changes privileges.
COMMANDS = ["curl ", "wget ", "nc ", "netcat", "bash -c", "sh -c", "python -c", "powershell", "certutil", "rundll32", "regsvr32"]
PRIVILEGED = ["sudo", "su", "pkexec"]
PRIVILEGE_COMMANDS = ["chmod +s", "setuid", "/etc/sudoers", "visudo"]
#: Patterns in commands, paths and requests with their points and reasons.
COMMAND_PATTERNS = [(r"(?i)\b(curl|wget)\b.*https?://", "Download from the network"), (r"(?i)-enc(odedcommand)?\b", "Encoded command"), (r"(?i)\b(nc|ncat|netcat)\b", "Raw network tool"), (r"(?i)base64\s+(-d|--decode)", "Decoded payload")]
PATH_PATTERNS = [(r"(?i)/tmp/|/dev/shm/|\\temp\\", "Path that anyone can write to")]
URL_PATTERN = r"(?i)(\.\./|union\s+select|<script|/etc/passwd|cmd=)"
PRIORITIES = [("CRITICAL", 60), ("HIGH", 35), ("MEDIUM", 15)]


def _holds(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def bursts(frame: LogFrame, least: int = 2, attempts: int = 10) -> DataFrame:
    """source_ip, username, n_failures, attempts, severity, score: repeated failures, or one that states many attempts."""
    failed = frame.df.where((frame.value("action") == "failed_login") | ((frame.value("event_type") == "user_auth") & frame.value("message").contains("fail")))
    name = lambda f: F.when(frame.value(f) == "", "unknown").otherwise(F.col(f)).alias(f)
    stated = F.coalesce(F.regexp_extract("message", r"\((\d+) +attempts?\)", 1).try_cast("int"), F.lit(1))
    out = failed.groupBy(name("source_ip"), name("username")).agg(F.count("*").alias("n_failures"), F.max(stated).alias("attempts"))
    out = out.where((F.col("n_failures") >= least) | (F.col("attempts") >= attempts))
    many = F.col("attempts") >= 50
    return out.select("*", F.when(many, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(many, 80).otherwise(55).alias("score"))


def scans(frame: LogFrame, least: int = 10) -> DataFrame:
    """source_ip and n_destinations of addresses that met many destinations."""
    pairs = frame.df.where((frame.value("source_ip") != "") & (frame.value("destination_ip") != ""))
    return pairs.groupBy("source_ip").agg(F.countDistinct("destination_ip").alias("n_destinations")).where(F.col("n_destinations") >= least)


def privileges(frame: LogFrame) -> DataFrame:
    """pos, rule: privileged processes that did not fail, or commands on the configuration of privileges."""
    process = frame.value("process_name").isin(PRIVILEGED) & ~frame.value("action").contains("fail")
    rule = F.when(process, "PRIV-001").when(_holds(frame.value("command"), PRIVILEGE_COMMANDS), "PRIV-002")
    return frame.df.select("pos", rule.alias("rule")).where("rule is not null")


def commands(frame: LogFrame) -> DataFrame:
    """pos of rows whose command holds a part of interest."""
    return frame.df.where(_holds(frame.value("command"), COMMANDS)).select("pos")


def findings(frame: LogFrame) -> DataFrame:
    """All detections in one shape: finding (a SHA-256 of rule and subject), rule, subject, severity, score, n_evidence, confidence. Equal findings appear once."""
    row = lambda df, rule, subject, severity, score, n: df.select(F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), subject.alias("subject"), severity.alias("severity"), score.cast("int").alias("score"), n.cast("long").alias("n_evidence"))
    pos = F.col("pos").cast("string")
    priv = F.col("rule") == "PRIV-001"
    every = [
        row(bursts(frame), "AUTH-BURST-001", F.concat_ws("|", "source_ip", "username"), F.col("severity"), F.col("score"), F.col("n_failures")),
        row(auth_chains(frame), "AUTH-CHAIN-002", F.concat_ws("|", "failed", "success"), F.lit("CRITICAL"), F.lit(95), F.lit(2)),
        row(privileges(frame), F.col("rule"), pos, F.when(priv, "MEDIUM").otherwise("HIGH"), F.when(priv, 45).otherwise(75), F.lit(1)),
        row(commands(frame), "EXEC-001", pos, F.lit("MEDIUM"), F.lit(50), F.lit(1)),
        row(scans(frame), "NET-001", F.col("source_ip"), F.lit("HIGH"), F.lit(70), F.least(F.col("n_destinations"), F.lit(100))),
    ]
    sure = F.when(F.col("rule").isin("AUTH-CHAIN-002", "AUTH-BURST-001", "NET-001") & (F.col("n_evidence") >= 2), "HIGH").when(F.col("n_evidence") >= 2, "MEDIUM").otherwise("LOW")
    out = reduce(DataFrame.unionByName, every)
    return out.select(F.sha2(F.concat_ws("|", "rule", "subject"), 256).alias("finding"), "*", sure.alias("confidence")).dropDuplicates(["finding"])


def event_scores(frame: LogFrame) -> DataFrame:
    """pos, score, priority, reasons. Failures are counted per address first; the counts are joined back on the address."""
    severity, action, kind, command = (frame.value(f) for f in ("severity", "action", "event_type", "command"))
    failed = (action == "failed_login") | kind.contains("failed login")
    by_ip = frame.df.where((action == "failed_login") & (frame.value("source_ip") != "")).groupBy(F.col("source_ip").alias("__ip")).agg(F.count("*").alias("__failures"))
    rows = frame.df.join(by_ip, F.col("source_ip") == F.col("__ip"), "left")
    many = failed & (F.col("__failures") >= 10)
    rules = [
        (severity == "critical", 40, F.lit("Critical log severity")),
        (severity == "high", 30, F.lit("High log severity")),
        (severity == "medium", 10, F.lit("Medium log severity")),
        (failed, 25, F.lit("Failed authentication attempt")),
        (many, 20, F.concat(F.lit("Repeated failures from "), F.col("source_ip"), F.lit(" ("), F.col("__failures").cast("string"), F.lit(" attempts)"))),
        (action.isin("process_create", "command_exec") | kind.contains("processcreate"), 5, F.lit("Process/command execution event")),
        (kind.contains("network"), 5, F.lit("Network activity")),
        *((command.rlike(p), 15, F.lit(reason)) for p, reason in COMMAND_PATTERNS),
        *((command.rlike(p), 20, F.lit(reason)) for p, reason in PATH_PATTERNS),
        (frame.value("message").rlike(URL_PATTERN), 25, F.lit("Suspicious URL/request pattern")),
        (frame.value("destination_ip") != "", 3, F.lit("External/network destination present")),
        (frame.value("message").contains("access denied") & ~action.isin("failed_login", "failed"), 10, F.lit("Access denied indicator")),
    ]
    score = sum((F.when(c, points).otherwise(0) for c, points, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(c, reason) for c, _, reason in rules)))
    priority = F.lit("LOW")
    for name, least in reversed(PRIORITIES):
        priority = F.when(F.col("score") >= least, name).otherwise(priority)
    return rows.select("pos", score.alias("score"), reasons.alias("reasons")).select("pos", "score", priority.alias("priority"), "reasons")
