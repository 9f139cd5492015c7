"""Query plans given as JSON-like dictionaries, turned into Spark columns.

A plan's ``operation`` is a condition (EXACT, CONTAINS, PREFIX, REGEX, RANGE, TIME_RANGE, IN, AND, OR, NOT) or a result
over the rows that its ``conditions`` select (COUNT, DISTINCT, GROUP, SORT, TOP_K). Anything unknown raises PlanError:
a condition that can't be understood never widens the result.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..logframe import LogFrame
from ..stored import written

RESULTS = {"COUNT", "DISTINCT", "GROUP", "SORT", "TOP_K"}


class PlanError(ValueError):
    pass


def _time(value) -> Column:
    try:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError as e:
        raise PlanError(f"no time: {value!r}") from e
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc)).cast("timestamp")


def _text(plan: dict, key: str = "value") -> str:
    if plan.get(key) is None:
        raise PlanError(f"{plan.get('operation')} needs {key!r}")
    return str(plan[key]).strip().lower()


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError) as e:
        raise PlanError(f"no number: {value!r}") from e


def predicate(plan: dict, frame: LogFrame) -> Column:
    """The rows that a condition selects; never null."""
    kind = str(plan.get("operation", "EXACT" if "field" in plan else "")).upper()
    children = plan.get("conditions") or []
    if kind in ("AND", "OR"):
        parts = [predicate(c, frame) for c in children]
        return reduce((lambda a, b: a & b) if kind == "AND" else (lambda a, b: a | b), parts, F.lit(kind == "AND"))
    if kind == "NOT":
        if len(children) != 1:
            raise PlanError("NOT takes one condition")
        return ~predicate(children[0], frame)
    if kind == "TIME_RANGE":
        low, high = plan.get("start"), plan.get("end")
        if low is None and high is None:
            raise PlanError("TIME_RANGE needs a start or an end")
        out = F.col("ts").isNotNull()
        out = out & (F.col("ts") >= _time(low)) if low is not None else out
        return F.coalesce(out & (F.col("ts") <= _time(high)) if high is not None else out, F.lit(False))
    if kind not in ("EXACT", "CONTAINS", "PREFIX", "REGEX", "RANGE", "IN"):
        raise PlanError(f"unknown operation {kind!r}")
    field = str(plan.get("field", ""))
    if field not in frame.fields:
        raise PlanError(f"unknown field {field!r}")
    ready = f"{field}_norm"
    value = F.col(ready) if ready in frame.df.columns else frame.value(field)
    if kind == "EXACT":
        return value == _text(plan)
    if kind == "CONTAINS":
        return value.contains(_text(plan))
    if kind == "PREFIX":
        return value.startswith(_text(plan))
    if kind == "IN":
        if not isinstance(plan.get("values"), (list, tuple, set)):
            raise PlanError("IN needs values")
        return value.isin([str(v).strip().lower() for v in plan["values"]]) if plan["values"] else F.lit(False)
    if kind == "REGEX":
        try:
            re.compile(str(plan.get("value")))
        except re.error as e:
            raise PlanError(f"no pattern: {plan.get('value')!r}") from e
        return value.rlike("(?i)" + str(plan["value"]))
    number, low, high = value.try_cast("double"), plan.get("min"), plan.get("max")
    out = number.isNotNull() & ~F.isnan(number)
    out = out & (number >= _number(low)) if low is not None else out
    return F.coalesce(out & (number <= _number(high)) if high is not None else out, F.lit(False))


def run(plan: dict, frame: LogFrame) -> DataFrame:
    """Rows of the frame for a condition (with ``limit``: the first by pos), or the result that the plan asks for.

    COUNT gives count. DISTINCT and GROUP give value (and count) of ``field``, empty ones left out; GROUP also ``n_groups``, of all groups, before its
    limit (50). SORT and TOP_K (limit 10) order rows by ``field`` as text, or as numbers if ``numeric``; ``descending`` is the default of TOP_K.
    """
    kind = str(plan.get("operation", "")).upper()
    if kind not in RESULTS:
        rows = frame.df.where(predicate(plan, frame))
        return rows.orderBy("pos").limit(int(plan["limit"])) if plan.get("limit") is not None else rows
    children = plan.get("conditions") or []
    if any(str(c.get("operation", "")).upper() in RESULTS for c in children):
        raise PlanError(f"{kind} stands at the top of a plan only")
    rows = frame.df.where(predicate({"operation": "AND", "conditions": children}, frame))
    if kind == "COUNT":
        return rows.agg(F.count("*").alias("count"))
    field = str(plan.get("field", ""))
    if field not in frame.fields:
        raise PlanError(f"unknown field {field!r}")
    value = frame.value(field)
    if kind in ("DISTINCT", "GROUP"):
        groups = rows.select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("count"))
        if kind == "DISTINCT":
            return groups.select("value")
        n = groups.agg(F.count("*").alias("n_groups"))
        return groups.orderBy(F.desc("count"), "value").limit(int(plan.get("limit", 50))).withColumn("n_groups", n.scalar())
    key = value.try_cast("double") if plan.get("numeric") else value
    order = F.desc(key) if plan.get("descending", kind == "TOP_K") else F.asc(key)
    rows = rows.orderBy(order, "pos")
    limit = plan.get("limit", 10 if kind == "TOP_K" else None)
    return rows.limit(int(limit)) if limit is not None else rows


def finalize(plan: dict, frame: LogFrame) -> DataFrame:
    """The rows of a condition (the first ``limit`` by pos) with ``count``, of all matches, ``returned_count``, ``truncated`` and ``exhaustive``.

    The page and the count come of one scan: matches are counted as they pass on to the page.
    """
    if str(plan.get("operation", "")).upper() in RESULTS:
        raise PlanError("only conditions have a page")
    matches = Observation("matches")
    rows = frame.df.where(predicate(plan, frame)).observe(matches, F.count("*").alias("n"))
    limit = plan.get("limit")
    page = written(rows.orderBy("pos").limit(int(limit)) if limit is not None else rows, "page")
    count = matches.get["n"]
    returned = min(count, int(limit)) if limit is not None else count
    return page.withColumns({"count": F.lit(count).cast("long"), "returned_count": F.lit(returned).cast("long"), "truncated": F.lit(returned < count), "exhaustive": F.lit(returned == count)})
