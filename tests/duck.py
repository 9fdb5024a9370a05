"""DuckDB twins: run an oracle's SQL over a folder of tables, and compare results as sorted texts."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, str):
        return v
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        f = float(v)
        return f"{f:.0f}" if f.is_integer() else f"{f:.8g}"
    except (TypeError, ValueError):
        return str(v)


def normal(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(map(_text, r)) for r in df[cols].astype(object).itertuples(index=False))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = normal(a), normal(b)
    assert len(x) == len(y)
    assert x == y
