"""Who acted, by the numbers that a system gives its users: identities learnt from an attacker's rows, and the rows that they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..logframe import LogFrame
from ..stored import written
from .correlation import failures_then_success

#: Numbers of root and of nobody, which identify no one.
UNSET = ["0", "-1", "4294967295"]
#: Fields that an identity is found in, and those it is learnt from: an effective number is a role, not a person.
FOUND_IN, LEARNT_FROM = ["uid", "euid", "auid"], ["uid", "auid"]


def main_actor(frame: LogFrame, least: int = 3) -> DataFrame:
    """username and source_ip with most failed logins, at least ``least``; ties by name and address. No row if nobody failed as often: a success is not asked for."""
    return failures_then_success(frame, least).orderBy(F.desc("n_failures"), "username", "source_ip").limit(1).select("username", "source_ip")


def _values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The identities in the columns, each once."""
    return rows.select(F.explode(F.array_distinct(F.array(*columns))).alias("identity")).where((F.col("identity") != "") & ~F.col("identity").isin(UNSET)).distinct()


def learn(frame: LogFrame, actors: DataFrame, rounds: int | None = None) -> DataFrame:
    """identity: the numbers of the actors' rows (same user or address), then those of the rows that hold such a number, until nothing is new or for ``rounds`` rounds of that.

    Works on the distinct combinations of names and numbers, which are far fewer than rows. Each round joins only what was new in the one before and is written,
    so a plan never grows. Root and unset numbers teach nothing. Fields that the log lacks are passed over.
    """
    found, taught = ([c for c in names if c in frame.fields] for names in (FOUND_IN, LEARNT_FROM))
    facts = written(frame.df.select(*(frame.value(c).alias(c) for c in dict.fromkeys(["username", "source_ip", *found, *taught]))).distinct(), "facts")
    seeds = [facts.join(actors.select(F.lower(F.trim(c)).alias(c)).where(F.col(c) != "").distinct(), c, "left_semi") for c in ("username", "source_ip")]
    known = new = written(_values(seeds[0].unionByName(seeds[1]), taught), "identities")
    while rounds != 0 and not new.isEmpty():
        reached = [facts.join(new.withColumnRenamed("identity", c), c, "left_semi") for c in found]
        every = reached[0]
        for other in reached[1:]:
            every = every.unionByName(other)
        new = written(_values(every, taught).join(known, "identity", "left_anti"), "identities")
        known = known.unionByName(new)
        rounds = None if rounds is None else rounds - 1
    return known


def scope(frame: LogFrame, actors: DataFrame, identities: DataFrame) -> DataFrame:
    """pos and reasons (fields, joined by commas) of the rows of the actors or of one of the identities.

    The log is read once, as field and value; what is looked for is a table of the same form.
    """
    found = [c for c in FOUND_IN if c in frame.fields]
    keys = [actors.select(F.lit(c).alias("field"), F.lower(F.trim(c)).alias("value")) for c in ("username", "source_ip")]
    keys += [identities.select(F.lit(c).alias("field"), F.col("identity").alias("value")) for c in found]
    every = keys[0]
    for other in keys[1:]:
        every = every.unionByName(other)
    hits = frame.long(["username", "source_ip", *found]).join(every.distinct(), ["field", "value"], "left_semi")
    return hits.groupBy("pos").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("reasons"))
