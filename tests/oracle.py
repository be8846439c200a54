"""Spark result against DuckDB result, as multisets of normalised rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if v is None or isinstance(v, (str, bool)):
        return v
    try:
        return int(v) if v == int(v) else float(f"{float(v):.9g}")
    except (TypeError, ValueError):
        return str(v)


def spark_rows(df) -> Counter:
    order = sorted(df.columns)
    return Counter(tuple(_norm(r[c]) for c in order) for r in df.select(*order).toLocalIterator())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{glob}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    names, want = duck_rows(sql, sf_dir)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    got = spark_rows(df)
    if got != want:
        return f"{sum(got.values())} rows, expected {sum(want.values())}; extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
    return ""
