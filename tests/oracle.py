"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows(table):
    return sorted((tuple(plain(x) for x in r) for r in table), key=repr)


def check(df, connection, sql):
    names = sorted(df.columns)
    found = connection.sql(sql)
    assert names == sorted(found.columns)
    mine = rows(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    theirs = rows(found.select(*[f'"{n}"' for n in names]).fetchall())
    assert mine == theirs
