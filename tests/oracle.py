"""Side-by-side check of a Spark query against its DuckDB oracle SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from textloom.sources.tables import TABLES


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
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=repr)


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> list[str]:
    problems = []
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        problems.append(f"columns {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}")
        return problems
    if len(spark_pdf) != len(oracle_pdf):
        problems.append(f"rows {len(spark_pdf)} vs {len(oracle_pdf)}")
    a, b = rows_of(spark_pdf), rows_of(oracle_pdf)
    if a != b:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        problems.append(f"values differ: spark-only {diff} oracle-only {diff2}")
    return problems
