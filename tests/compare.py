"""Rows of a query and of its SQL, in one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(shown(r[i]) for i in order) for r in data)


def database(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def assert_same(spark, sf, query, sql):
    df = query(spark, sf)
    want = database(sf).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
