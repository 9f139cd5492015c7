"""Column functions on times; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted besides ISO 8601 with or without a zone.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z"]


def parse_time(c: Column, year: int | None = None) -> Column:
    """A timestamp or null. Times without a zone are UTC; syslog's times without a year take ``year``."""
    text = F.trim(c.cast("string"))
    ways = [F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text))]
    ways += [F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]
    if year is not None:
        stamp = F.regexp_replace(F.regexp_extract(text, r"^([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d)", 1), " +", " ")
        ways.append(F.try_to_timestamp(F.concat(F.lit(f"{year} "), stamp), F.lit("yyyy MMM d HH:mm:ss")))
    return F.coalesce(*ways)


def bucket_start(ts: Column, seconds: int) -> Column:
    """The start of the bucket in seconds since 1970."""
    return (F.floor(F.unix_seconds(ts) / seconds) * seconds).cast("long")
