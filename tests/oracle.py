"""Compares registered queries with their SQL, as value-equal multisets of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


def differences(got, con, sql: str) -> str:
    """Empty if the DataFrame and the SQL have the same columns and rows."""
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    names = sorted(got.columns)
    rows = sorted((tuple(_value(r[n]) for n in names) for r in got.collect()), key=repr)
    at = [want.columns.index(n) for n in names]
    other = sorted((tuple(_value(r[k]) for k in at) for r in want.fetchall()), key=repr)
    if len(rows) != len(other):
        return f"{len(rows)} and {len(other)} rows, such as {rows[:1]} and {other[:1]}"
    bad = [(a, b) for a, b in zip(rows, other, strict=True) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, such as {bad[0]}" if bad else ""
