"""Comparing a query with its SQL."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def against_sql(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, data)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    other = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert own == other
