"""Rows of a query against those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = ordered(df.select(*names).collect())
    r = connection(folder).execute(sql)
    have = [x[0] for x in r.description]
    assert sorted(have) == names
    at = [have.index(x) for x in names]
    assert got == ordered([[row[i] for i in at] for row in r.fetchall()])
    return got
