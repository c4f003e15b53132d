"""Rows of Spark and of DuckDB, made comparable."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if hasattr(x, "__len__") and not isinstance(x, str):
        return repr([y.item() if hasattr(y, "item") else y for y in x])
    if x is None or x is pd.NaT or x != x:
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)
