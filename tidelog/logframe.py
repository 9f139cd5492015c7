"""A log as a DataFrame with a stable row identity and named roles of its columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import norm

#: Columns by kind of entity; those that a frame lacks are passed over.
ENTITIES = {
    "ip": ["source_ip", "destination_ip", "client_ip", "remote_ip"],
    "user": ["username", "user", "account", "target_user"],
    "host": ["host", "hostname", "computer"],
    "process": ["process_name", "process", "image"],
    "file": ["file_path", "file", "target_file"],
    "domain": ["domain", "dns_query"],
    "url": ["url", "uri"],
    "hash": ["hash", "hashes", "sha256", "md5"],
    "session": ["session_id", "audit_session"],
    "command": ["command", "command_line"],
    "port": ["source_port", "destination_port"],
}


@dataclass(frozen=True)
class LogFrame:
    """``df`` holds ``pos`` (a whole number for each row), ``ts`` (timestamp) and the string columns ``fields``."""

    df: DataFrame
    fields: tuple[str, ...]

    def on(self, df: DataFrame) -> LogFrame:
        return replace(self, df=df)

    def require(self, field: str) -> str:
        if field not in self.fields:
            raise ValueError(f"unknown field {field!r}; there are {', '.join(self.fields)}")
        return field

    def value(self, field: str) -> Column:
        return norm(self.require(field))

    def entity(self, kind: str) -> list[str]:
        if kind not in ENTITIES:
            raise ValueError(f"unknown kind of entity {kind!r}")
        return [c for c in ENTITIES[kind] if c in self.fields]

    def long(self, fields: list[str] | None = None) -> DataFrame:
        """pos, field and normalised value of every value that is not empty."""
        fields = [self.require(f) for f in fields or self.fields]
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), self.value(f).alias("value")) for f in fields))
        return self.df.select("pos", F.explode(F.filter(pairs, lambda p: p["value"] != "")).alias("p")).select("pos", "p.field", "p.value")


def normalized(frame: LogFrame) -> LogFrame:
    """With a column ``<field>_norm`` for each field: filters on them reach the Parquet scan once the frame is written."""
    return frame.on(frame.df.select("*", *(frame.value(f).alias(f"{f}_norm") for f in frame.fields)))


#: The address of a user's number: four bytes whatever the number, so that all of them are addresses. The first 16,777,216 users have one each.
ADDRESS = "concat('10.', ({0}) div 4096 % 256, '.', ({0}) div 16 % 256, '.', ({0}) % 16 + ({0}) div 1048576 % 16 * 16)"


def events_log(spark: SparkSession, sf_dir: str) -> LogFrame:
    """The events table as a log: errors stand for failed and purchases for successful logins, and what a log has besides is derived from the columns."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS pos", "cast(ts AS timestamp) AS ts", "unix_micros(cast(ts AS timestamp)) AS us", "event_type", "value",
        "cast(user_id AS string) AS username",
        f"{ADDRESS.format('user_id')} AS source_ip",
        "concat('192.168.', event_id % 7, '.', cast(floor(value) AS bigint) % 256) AS destination_ip",
        "CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'purchase' THEN 'successful_login' ELSE event_type END AS action",
        "CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity",
        "get_json_object(props, '$.k') AS code",
    )
    log = log.selectExpr(
        "*",
        "CASE event_type WHEN 'click' THEN 'curl' WHEN 'view' THEN 'sudo' ELSE '' END AS process_name",
        "CASE event_type WHEN 'click' THEN concat('curl -o /tmp/f', code, ' http://h', code, '.example.com/x') WHEN 'view' THEN concat('cat /etc/f', code, '.conf') ELSE '' END AS command",
        "concat(event_type, ' by user ', username, ' from ', source_ip, ' code ', code) AS message",
    )
    return LogFrame(log, ("event_type", "username", "source_ip", "destination_ip", "action", "severity", "code", "process_name", "command", "message"))


#: The same log in DuckDB's SQL.
EVENTS_LOG = """
base AS (SELECT event_id AS pos, ts, epoch_us(ts) AS us, event_type, value, CAST(user_id AS VARCHAR) AS username,
    '10.' || CAST(user_id // 4096 % 256 AS VARCHAR) || '.' || CAST(user_id // 16 % 256 AS VARCHAR) || '.' || CAST(user_id % 16 + user_id // 1048576 % 16 * 16 AS VARCHAR) AS source_ip,
    '192.168.' || CAST(event_id % 7 AS VARCHAR) || '.' || CAST(CAST(floor(value) AS BIGINT) % 256 AS VARCHAR) AS destination_ip,
    CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'purchase' THEN 'successful_login' ELSE event_type END AS action,
    CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity,
    json_extract_string(props, '$.k') AS code FROM events),
log AS (SELECT *, CASE event_type WHEN 'click' THEN 'curl' WHEN 'view' THEN 'sudo' ELSE '' END AS process_name,
    CASE event_type WHEN 'click' THEN 'curl -o /tmp/f' || code || ' http://h' || code || '.example.com/x' WHEN 'view' THEN 'cat /etc/f' || code || '.conf' ELSE '' END AS command,
    event_type || ' by user ' || username || ' from ' || source_ip || ' code ' || code AS message FROM base)
"""


def audit_log(spark: SparkSession, sf_dir: str) -> LogFrame:
    """The events' log with what audit records tell of who acted: user numbers, login numbers (half of the users have none), processes and sessions."""
    log = events_log(spark, sf_dir)
    df = log.df.selectExpr(
        "*",
        "cast(1000 + cast(username AS bigint) div 3 AS string) AS uid",
        "CASE WHEN event_type = 'view' THEN '0' ELSE cast(1000 + cast(username AS bigint) div 3 AS string) END AS euid",
        "CASE WHEN cast(username AS bigint) % 10 < 5 THEN cast(1000000 + cast(username AS bigint) div 5 AS string) ELSE '4294967295' END AS auid",
        "cast(pos % 4001 AS string) AS pid",
        "cast(pos % 211 AS string) AS ppid",
        "cast(pos div 3 AS string) AS audit_serial",
        "concat('s', cast(username AS bigint) % 61, '-', pos % 7) AS audit_session",
    )
    return LogFrame(df, (*log.fields, "uid", "euid", "auid", "pid", "ppid", "audit_serial", "audit_session"))


AUDIT_LOG = """
audit AS (SELECT *, CAST(1000 + CAST(username AS BIGINT) // 3 AS VARCHAR) AS uid, CASE WHEN event_type = 'view' THEN '0' ELSE CAST(1000 + CAST(username AS BIGINT) // 3 AS VARCHAR) END AS euid,
    CASE WHEN CAST(username AS BIGINT) % 10 < 5 THEN CAST(1000000 + CAST(username AS BIGINT) // 5 AS VARCHAR) ELSE '4294967295' END AS auid,
    CAST(pos % 4001 AS VARCHAR) AS pid, CAST(pos % 211 AS VARCHAR) AS ppid, CAST(pos // 3 AS VARCHAR) AS audit_serial, 's' || CAST(username AS BIGINT) % 61 || '-' || pos % 7 AS audit_session FROM log)
"""
