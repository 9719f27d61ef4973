"""Compares a DataFrame with DuckDB's rows for the same tables, regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.9g}" if isinstance(x, (float, decimal.Decimal)) or abs(x) < 2**40 else str(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
