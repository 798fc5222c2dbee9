"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql).fetchall()
    return [d[0] for d in con.description], found


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return repr(value)


def same(df, sf_dir: str, sql: str) -> None:
    columns, expected = sql_rows(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    got = df.select(*columns).toArrow()
    mine = sorted(tuple(map(plain, row)) for row in zip(*(got.column(c).to_pylist() for c in columns))) if got.num_rows else []
    assert mine == sorted(tuple(map(plain, row)) for row in expected)
