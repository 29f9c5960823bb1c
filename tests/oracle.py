"""Comparison of a query with its SQL run by DuckDB."""

import glob
import math
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        pattern = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{pattern}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def same(spark_df, con, sql):
    rel = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns)
    a, b = rows(spark_df.columns, spark_df.collect()), rows(rel.columns, rel.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
