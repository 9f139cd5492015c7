"""Syslog and Linux audit lines as logs, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_time, printable_hex, unquote
from ..functions.iocs import IPV4

#: The header of a syslog line and the head of an audit record.
HEADER = r"^(?:<\d+>)?([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+) +(\S+) +([^\s:\[]+)(?:\[(\d+)\])?: ?(.*)$"
AUDIT = r"type=(\w+) msg=audit\((\d+)\.(\d+):(\d+)\):"
FIELD = r"(\w+)=(\"[^\"]*\"|'[^']*'|\S+)"


def read_syslog(spark: SparkSession, path: str) -> DataFrame:
    """line and value of each line that is not blank."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")


def audit_fields(text: Column) -> Column:
    """A map of the keys and unquoted values of an audit record; the last of equal keys counts."""
    keys, values = F.regexp_extract_all(text, F.lit(FIELD), F.lit(1)), F.regexp_extract_all(text, F.lit(FIELD), F.lit(2))
    pairs = F.arrays_zip(F.reverse(keys).alias("k"), F.reverse(values).alias("v"))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"].alias("k"), unquote(p["v"]).alias("v"))))


def arguments(fields: Column) -> Column:
    """a0, a1, ... of an EXECVE record in the order of their numbers, joined by blanks; hexadecimal ones decoded."""
    entries = F.filter(F.map_entries(fields), lambda e: e["key"].rlike(r"^a\d+$"))
    numbered = F.array_sort(F.transform(entries, lambda e: F.struct(F.substring(e["key"], 2, 9).cast("int").alias("n"), printable_hex(e["value"]).alias("v"))))
    return F.array_join(F.transform(numbered, lambda e: e["v"]), " ")


def parse_syslog(lines: DataFrame, year: int) -> DataFrame:
    """For lines (line, value): line, timestamp, ts, host, process_name, pid, message, username, source_ip, action, severity, command, audit_type, audit_serial, attrs.

    Times without a year are of ``year``. A line without a header is a message.
    """
    value = F.col("value")
    part = lambda k: F.nullif(F.regexp_extract(value, HEADER, k), F.lit(""))
    audit = lambda k: F.nullif(F.regexp_extract(value, AUDIT, k), F.lit(""))
    rows = lines.select("line", "value", part(1).alias("stamp"), part(2).alias("host"), part(3).alias("process_name"), part(4).alias("pid"), F.coalesce(part(5), value).alias("message"), audit(1).alias("audit_type"), audit(2).alias("epoch"), audit(4).alias("audit_serial"))
    rows = rows.withColumn("attrs", F.when(F.col("audit_type").isNotNull(), audit_fields(value)))
    get = lambda k: F.nullif(F.element_at("attrs", k), F.lit(""))
    text = F.lower("message")
    found = lambda p: F.nullif(F.regexp_extract("message", p, 1), F.lit(""))
    user = F.coalesce(get("acct"), found(r"(?:for|user) (?:invalid user )?([A-Za-z_][\w.-]*|\d+) from"), found(r"\buser[= ]([A-Za-z_][\w.-]*|\d+)"), found(r"for user ([A-Za-z_][\w.-]*)"))
    ip = F.coalesce(get("addr"), get("rhost"), found(rf"from ({IPV4})"), found(rf"rhost=({IPV4})"))
    failed = text.rlike("fail|invalid user|denied|res=failed")
    good = text.rlike("accepted|session opened|res=success|authentication success")
    action = F.when(F.col("audit_type") == "EXECVE", "command_exec").when(failed, "failed_login").when(good, "successful_login").when(text.contains("session closed"), "session_end")
    severity = F.when(text.rlike("critical|emergency|panic"), "critical").when(failed, "high").when(text.rlike("warn|error"), "medium").otherwise("low")
    command = F.coalesce(F.nullif(F.regexp_extract("message", r"COMMAND=(.+)$", 1), F.lit("")), F.when(F.col("audit_type") == "EXECVE", arguments(F.col("attrs"))))
    ts = F.coalesce(F.timestamp_seconds(F.col("epoch").cast("long")), parse_time(F.col("stamp"), year))
    return rows.select("line", F.coalesce("stamp", "epoch").alias("timestamp"), ts.alias("ts"), "host", F.coalesce(get("comm"), "process_name").alias("process_name"), F.coalesce(get("pid"), "pid").alias("pid"), "message", user.alias("username"), ip.alias("source_ip"), action.alias("action"), severity.alias("severity"), command.alias("command"), "audit_type", "audit_serial", "attrs")


def merge_audit(parsed: DataFrame) -> DataFrame:
    """EXECVE records with the fields of the last SYSCALL record of their serial; the record's own win. Other rows stay as they are."""
    calls = parsed.where("audit_type = 'SYSCALL'").groupBy(F.col("audit_serial").alias("__s")).agg(F.max_by("attrs", "line").alias("__call"))
    joined = parsed.join(calls, (F.col("audit_serial") == F.col("__s")) & (F.col("audit_type") == "EXECVE"), "left")
    own = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    call = F.coalesce("__call", F.create_map().cast("map<string,string>"))
    both = F.map_concat(own, F.map_filter(call, lambda k, v: ~F.map_contains_key(own, k)))
    return joined.withColumn("attrs", F.when(F.col("__call").isNotNull(), both).otherwise(F.col("attrs"))).withColumn("process_name", F.coalesce(F.element_at("__call", "comm"), "process_name")).drop("__s", "__call")
