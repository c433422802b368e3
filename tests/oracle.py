"""Compares a query's rows with its DuckDB SQL."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, table) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in table), key=repr)


def mismatch(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs, if anything."""
    df = query(spark, sf_dir)
    c = duck(sf_dir)
    rel = c.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows differ, such as {bad[:2]}" if bad else None
