"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def shown(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


def same(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want
    return len(got)
