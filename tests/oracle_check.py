"""Run a registered query on Spark and its oracle SQL on DuckDB and compare
row count, column names and rounded values (order-insensitive)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from tidemark.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5) + 0.0
    if isinstance(v, (pd.Timestamp,)):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, name: str, fn, sql: str, sf_dir: str, tol: float = 1e-5):
    sdf = fn(spark, sf_dir)
    left = sdf.toPandas()
    right = duck(sf_dir).sql(sql).df()
    problems = []
    if sorted(left.columns) != sorted(right.columns):
        problems.append(f"columns differ: spark={sorted(left.columns)} oracle={sorted(right.columns)}")
        return problems, left, right
    cols = sorted(left.columns)
    if len(left) != len(right):
        problems.append(f"rows differ: spark={len(left)} oracle={len(right)}")
    lrows = sorted((tuple(_norm(x) for x in r) for r in left[cols].itertuples(index=False)), key=repr)
    rrows = sorted((tuple(_norm(x) for x in r) for r in right[cols].itertuples(index=False)), key=repr)
    bad = 0
    for a, b in zip(lrows, rrows):
        if a != b:
            ok = len(a) == len(b)
            for x, y in zip(a, b):
                if isinstance(x, float) and isinstance(y, float):
                    if abs(x - y) > tol * max(1.0, abs(y)):
                        ok = False
                elif x != y and not (x is None and y is None):
                    ok = False
            if not ok:
                bad += 1
                if bad <= 3:
                    problems.append(f"row differs: spark={a} oracle={b}")
    if bad:
        problems.append(f"{bad} rows differ")
    return problems, left, right
