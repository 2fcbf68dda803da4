"""Queries held against their SQL over the smallest test tables."""

import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(data=DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "~"
    return repr([_plain(x) for x in value]) if isinstance(value, (list, tuple)) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in found)


def check(spark, con, query, sql, data=DATA):
    df = query(spark, data)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
