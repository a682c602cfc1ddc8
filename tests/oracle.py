"""Comparing a query with its SQL in DuckDB, without regard to the order of rows and columns."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 9)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark_df, connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(spark_df.columns) == sorted(names)
    ours, theirs = bag(spark_df.columns, spark_df.collect()), bag(names, result.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
