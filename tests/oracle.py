"""Compares a query with its SQL in DuckDB: names, row counts, values regardless of order."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "NaN" if x != x else x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if isinstance(x, Decimal) else x


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*order).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
