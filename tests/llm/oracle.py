"""Compares a query with its oracle SQL on DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)


def same(df, sql, sf_dir):
    names, want = rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
