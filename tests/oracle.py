"""Runs a query and its SQL over one folder of tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def connection():
    c = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


def canonical(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.9g}" if isinstance(v, int | float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(canonical(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def agree(spark, c, name, query, oracle) -> None:
    got = query(spark, FOLDER)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if oracle is None:
        return  # it ran; its values are tested elsewhere
    want = c.execute(oracle).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
