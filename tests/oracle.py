"""Comparison of a query with its DuckDB twin on the same Parquet tables."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"create view {t} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def same(df, sql, sf_dir):
    cursor = connection(sf_dir).execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    theirs = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()]
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
