"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def rows_of(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    result = con.sql(sql)
    want_names, want = result.columns, result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a != b:
        only_a, only_b = [x for x in a if x not in b][:3] if len(a) < 3000 else a[:2], [x for x in b if x not in a][:3] if len(b) < 3000 else b[:2]
        return f"{len(a)} and {len(b)} rows; {only_a} against {only_b}"
    kinds = {n: t for n, t in df.dtypes}
    wide = {"BIGINT": {"bigint"}, "INTEGER": {"int"}, "VARCHAR": {"string"}, "DOUBLE": {"double"}, "BOOLEAN": {"boolean"}}
    odd = [(n, kinds[n], str(t)) for n, t in zip(want_names, result.types, strict=True) if kinds[n] not in wide.get(str(t), {kinds[n]})]
    return f"types {odd}" if odd else None
