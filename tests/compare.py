"""Equality of a Spark result and a DuckDB result, whatever the order of rows and columns."""

import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, np.ndarray | list):
        return str([plain(y) for y in x])
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, float | np.floating | Decimal):
        return None if math.isnan(x) else int(x) if float(x).is_integer() else float(f"{float(x):.9g}")
    return int(x) if isinstance(x, int | np.integer) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=repr)
