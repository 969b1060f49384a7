"""Runs a query on Spark and its equivalent on DuckDB, and compares rows whatever their order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def compare(spark, db, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    rel = db.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    if got == want:
        return ""
    odd = next(((a, b) for a, b in zip(got, want) if a != b), None)
    return f"{len(got)} rows against {len(want)}; columns {names}; first difference {odd}"
