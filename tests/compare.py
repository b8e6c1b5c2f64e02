"""Compares a Spark result with DuckDB SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        place = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from '{place}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None if columns and rows are equal (numbers of any kind by value), else what differs first."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    other = rows_of(names, found.fetchall())
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows"
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))
    num = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    key = lambda r: tuple((round(v, 6) if isinstance(v, float) else v) for v in map(num, r))
    mine, other = sorted(mine, key=lambda r: repr(key(r))), sorted(other, key=lambda r: repr(key(r)))
    for a, b in zip(mine, other, strict=True):
        if not all(same(num(x), num(y)) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return None
