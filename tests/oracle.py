"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

DATA = os.environ.get("CORVANE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    df = query(spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr)
    found = c.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(tidy(r[columns.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    assert got == want
