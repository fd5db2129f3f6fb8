"""Runs a query's SQL in DuckDB and holds both results against each other."""

import os
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    order = [found.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    got = sorted((plain(tuple(r)) for r in df.collect()), key=repr)
    assert got == want
