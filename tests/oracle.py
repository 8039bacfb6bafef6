"""Compares a query with its SQL on one folder of tables."""

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return str(v) if math.isnan(v) or math.isinf(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def assert_same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
