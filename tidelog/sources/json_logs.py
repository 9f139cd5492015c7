"""JSON exports as logs: one record on a line, an array, a wrapper around an array, or records one after another."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_time
from ..logframe import LogFrame
from ..operators.running import positions
from .json_split import split_json

#: Keys that wrap a list of records, and the names under which fields come.
WRAPPERS = ["events", "records", "logs", "items", "data", "results", "entries", "hits", "rows", "alerts", "Events", "Records"]
ALIASES = {
    "timestamp": ["timestamp", "@timestamp", "time", "UtcTime", "TimeCreated", "EventTime", "date"],
    "event_type": ["event_type", "EventType", "type", "category", "EventID"],
    "event_id": ["event_id", "EventID", "Id"],
    "source_ip": ["source_ip", "src_ip", "SourceIp", "IpAddress", "client_ip", "src"],
    "destination_ip": ["destination_ip", "dst_ip", "DestinationIp", "dest_ip", "dst"],
    "destination_port": ["destination_port", "dst_port", "DestinationPort"],
    "username": ["username", "user", "User", "TargetUserName", "account", "SubjectUserName"],
    "process_name": ["process_name", "process", "Image", "ProcessName"],
    "command": ["command", "CommandLine", "command_line", "cmd"],
    "host": ["host", "hostname", "Computer", "ComputerName"],
    "action": ["action", "outcome", "status", "result"],
    "severity": ["severity", "level", "Level", "priority"],
    "message": ["message", "Message", "msg", "description"],
    "file_path": ["file_path", "TargetFilename", "path", "file"],
    "hash": ["hash", "Hashes", "sha256", "md5"],
    "url": ["url", "uri", "request_url"],
    "source_port": ["source_port", "src_port", "SourcePort", "IpPort"],
    "pid": ["pid", "ProcessId", "process_id", "NewProcessId"],
    "ppid": ["ppid", "ParentProcessId", "parent_pid"],
    "uid": ["uid", "user_id"],
    "euid": ["euid", "effective_uid"],
    "auid": ["auid", "loginuid", "audit_uid"],
    "audit_serial": ["audit_serial", "serial"],
    "audit_session": ["audit_session", "ses", "session", "LogonId", "TargetLogonId"],
    "rule_name": ["rule_name", "RuleName", "rule", "signature"],
}
#: Windows event ids of logins.
FAILED_IDS, GOOD_IDS = ["4625", "529", "4771"], ["4624", "4648", "4776"]


def _flat(value, name: str, out: dict[str, str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flat(v, f"{name}_{k}" if name else str(k), out)
    elif isinstance(value, list) and any(isinstance(v, dict) for v in value):
        for k, v in enumerate(value):
            _flat(v, f"{name}_{k}", out)
    elif isinstance(value, list):
        out[name] = ", ".join("" if v is None else str(v) for v in value)
    elif value is not None:
        out[name] = json.dumps(value) if isinstance(value, bool) else str(value)


def flatten(record: dict) -> dict[str, str]:
    """Nested names joined by underscores, lists of plain values by commas; lists of objects are numbered. Nulls are left out."""
    out: dict[str, str] = {}
    _flat(record, "", out)
    return out


#: Names that a record has and a wrapper has not.
_NAMES = {n.lower() for names in ALIASES.values() for n in names}


def _records(text: str) -> Iterator[dict]:
    """The objects of a text that is an array, a wrapper, one object or several, one after another. What is not JSON ends it."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return
        if isinstance(value, dict):
            wrapped = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), None)
            wrapped = wrapped or max((v for v in value.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)), key=len, default=None) if not _NAMES & {k.lower() for k in value} else wrapped
            value = wrapped if wrapped is not None else [value]
        yield from (v for v in value if isinstance(v, dict)) if isinstance(value, list) else ()


def read_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """file, line and attrs (a map of flattened names) of each record.

    By default files hold a record on each line, and lines that are no object are passed over. With ``whole`` they hold arrays, wrappers and objects one after
    another, whatever the line ends; ``line`` is then the record's place in the file. Files are split among tasks either way. Order is that of the files.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, line, item, text in zip(batch["file"], batch["line"], batch["item"], batch["value"], strict=True):
                for n, record in enumerate(_items(text) if item else _records(text)):
                    rows.append((file, line + n if whole else line, flatten(record)))
            yield pd.DataFrame(rows, columns=["file", "line", "attrs"])

    if whole:
        texts = split_json(spark, path, WRAPPERS).select("file", "line", (F.col("kind") == "item").alias("item"), F.col("text").alias("value"))
    else:
        texts = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.lit(False).alias("item"), "value")
    return texts.mapInPandas(parse, "file string, line long, attrs map<string,string>")


def _items(text: str) -> list[dict]:
    """The object of a text that is an element of a list; none if it is not JSON."""
    try:
        return [json.loads(text)]
    except ValueError:
        return []


def _first(names: list[str]) -> Column:
    """The first value that is there, whatever the case of its name; else of a name that ends in one."""
    low = F.transform_keys("attrs", lambda k, v: F.lower(k))
    exact = [F.nullif(F.trim(F.element_at(low, n.lower())), F.lit("")) for n in names]
    ends = F.map_values(F.map_filter(low, lambda k, v: F.exists(F.array(*(F.lit("_" + n.lower()) for n in names)), lambda n: k.endswith(n)) & (F.trim(v) != "")))
    return F.coalesce(*exact, F.get(ends, F.lit(0)))


def normalize(raw: DataFrame, year: int | None = None) -> LogFrame:
    """A log of records with ``attrs``: normalised fields, ``ts``, ``timestamp_parse_failed`` and ``pos``, numbered in the order of file and line.

    Actions come from the stated one, else from Windows event ids, else from the text. Normalised values win over raw names; attrs keeps the raw ones.
    """
    rows = raw.select("file", "line", "attrs", *(_first(names).alias(f) for f, names in ALIASES.items()))
    text = F.lower(F.concat_ws(" ", "message", "event_type"))
    said = F.lower("action")
    action = F.when(F.col("action").isNotNull() & ~said.isin("0", "1"), said).when(F.col("event_id").isin(FAILED_IDS), "failed_login").when(F.col("event_id").isin(GOOD_IDS), "successful_login")
    action = action.when(text.rlike("fail(ed|ure).*(log|auth)|(log|auth).*fail"), "failed_login").when(text.rlike("accepted|success.*(log|auth)"), "successful_login")
    made = F.substring(F.concat_ws("; ", F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), 1, 2000)
    rows = rows.withColumns({"action": action, "severity": F.lower("severity"), "message": F.coalesce("message", made), "ts": parse_time(F.col("timestamp"), year)})
    rows = rows.withColumn("timestamp_parse_failed", F.col("timestamp").isNotNull() & F.col("ts").isNull())
    return LogFrame(numbered(rows, ["file", "line"]), tuple(ALIASES))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """With ``pos``, counted from 0 in an order. The ranges are written once, so a lost executor can't move a row from one to another."""
    return positions(rows, order, "pos")
