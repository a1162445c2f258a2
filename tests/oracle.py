"""Runs a query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    return round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return [tuple(df.columns), *sorted(repr(tuple(map(_plain, r))) for r in df.itertuples(index=False))]


def same(spark, sf_dir: str, query, sql: str) -> None:
    got, expected = rows(query(spark, sf_dir).toPandas()), rows(connection(sf_dir).sql(sql).df())
    assert got[0] == expected[0]
    assert len(got) == len(expected)
    assert got == expected
