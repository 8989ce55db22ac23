"""Holds a Spark result against DuckDB over the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str, **own: pd.DataFrame) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        if t not in own:
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, frame in own.items():
        c.register(name, frame)
    return c.execute(sql).df()


def _plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "None"
        if isinstance(x, float):
            return f"{x + 0.0:.6f}"
        if hasattr(x, "strftime"):
            return x.strftime("%Y-%m-%d")
        return str(x)

    df = df[sorted(df.columns)]
    whole = df.apply(lambda s: s.map(lambda x: float(x) if isinstance(x, int) and pd.api.types.is_float_dtype(s) else x))
    return sorted(tuple(map(cell, r)) for r in whole.astype(object).itertuples(index=False))


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    for c in got.columns:  # ints that one side holds as doubles because of nulls
        if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(expected[c]):
            got[c], expected[c] = got[c].astype(float), expected[c].astype(float)
    assert _plain(got) == _plain(expected)
