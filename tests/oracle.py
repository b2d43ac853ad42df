"""Spark results against DuckDB's for the same query."""

import os

import duckdb
import pandas as pd


def connect(d):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in sorted(os.listdir(d)):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    return con


def rows(df):
    def one(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x or x is pd.NA:
            return ""
        return repr(round(x, 6)) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))
