"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares columns, counts and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(x, 9) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted(tuple(plain(r[i]) for i in order) for r in data) if not any(None in r for r in data) else sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, d: str, run, text: str) -> str:  # noqa: ANN001
    """An empty string if both agree, else what differs."""
    got = run(spark, d)
    mine = [tuple(r) for r in got.collect()]
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a, b = rows(got.columns, mine), rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 1e-8 for p, q in zip(x, y, strict=True)):
            return f"{x} and {y}"
    types = [t for _, t in got.dtypes]
    return "" if not any(t.startswith(("decimal", "void")) for t in types) else f"types {types}"
