"""Comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

import math
from pathlib import Path


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return repr(round(float(v), 8) + 0.0)
    return str(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def duck(sql: str, sf_dir: str | None = None, **frames):
    """Column names and rows of sql over the tables of a folder, or over pandas frames."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet") if sf_dir else ():
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    for name, frame in frames.items():
        con.register(name, frame)
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, sql: str, sf_dir: str | None = None, **frames) -> None:
    columns, rows = duck(sql, sf_dir, **frames)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rows)
