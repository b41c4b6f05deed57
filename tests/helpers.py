"""What several tests need: tables from literal rows, comparison of a query with its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(df, con, sql):
    """Column names and rows of a DataFrame and of SQL, rows in any order."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)
    assert have == want
    return len(have)
