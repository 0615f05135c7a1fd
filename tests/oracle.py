"""Compares registered queries with their SQL on one data folder."""

from __future__ import annotations

import math

import duckdb

from sparkquill.sources.views import TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else round(v, 4)
    return str(v)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """'' if equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    names = sorted(df.columns)
    a = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
    b = sorted((tuple(norm(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall()), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows, {len(b)} expected"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else ""
