"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in (DATA / sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark, con, query, sql: str, sf: str) -> None:
    df = query(spark, str(DATA / sf))
    got = df.collect()
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, got) == table(columns, want.fetchall())
