"""Holds a Spark result against DuckDB's: the same columns, and the same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "normalize") and hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: [(v is None, str(type(v)) if isinstance(v, bool) else "", v if v is not None else 0) for v in r])


def difference(df, con, sql: str) -> str | None:
    """None if equal, else the first difference."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}: {next((x for x in zip(a, b) if x[0] != x[1]), None)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}: {x} and {y}"
    return None
