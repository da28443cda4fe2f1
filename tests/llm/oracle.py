"""Compares a query with its DuckDB SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(spark_rows):
    return sorted((tuple(r) for r in spark_rows), key=repr)


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert sorted(df.columns) == names
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
    return got
