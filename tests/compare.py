"""Runs a query in Spark and its reference SQL in DuckDB over the same tables, and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def normal(x: pd.DataFrame) -> list[tuple]:
    cols = []
    for c in sorted(x.columns):
        if x[c].dtype.kind in "fiu" or str(x[c].dtype) in ("Int64", "Int32"):
            cols.append(["-" if pd.isna(v) else f"{float(v) + 0:.5f}" for v in x[c]])
        else:
            cols.append(["-" if v is None or v is pd.NaT or v != v else str(v) for v in x[c]])
    return sorted(zip(*cols, strict=True))


def assert_same(spark_rows: pd.DataFrame, other: pd.DataFrame) -> None:
    assert sorted(spark_rows.columns) == sorted(other.columns)
    assert normal(spark_rows) == normal(other)
