"""What kind of log a file is, from its first lines."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .json_logs import _records, flatten
from .syslog import AUDIT, HEADER

#: Keys that mark an export.
MARKS = {"sysmon": {"utctime", "processguid", "image", "commandline", "parentimage", "hashes", "targetfilename"}, "windows": {"eventid", "channel", "provider", "computer", "targetusername", "logontype", "subjectusername"}}


def sniff(spark: SparkSession, path: str, lines: int = 20) -> str:
    """sysmon, windows, json, syslog or text: two marking keys make an export, a third of the lines with a header make a syslog."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect()]
    keys = {k.lower().rsplit("_", 1)[-1] for line in ["\n".join(head), *head] for record in _records(line) for k in flatten(record)}
    for kind, marks in MARKS.items():
        if len(keys & marks) >= 2:
            return kind
    if keys:
        return "json"
    full = [x for x in head if x.strip()]
    known = sum(bool(re.search(AUDIT, x) or re.match(HEADER, x)) for x in full)
    return "syslog" if full and 3 * known >= len(full) else "text"
