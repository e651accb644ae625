"""Compare a query with its SQL: rows in any order, columns by name."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def tables(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    return float(x) if isinstance(x, (float, np.floating)) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


def check(spark, con, query, sql, sf_dir):
    assert rows(query(spark, sf_dir).toPandas()) == rows(con.sql(sql).df())
