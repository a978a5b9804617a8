"""Holds a query's rows against DuckDB's."""

import glob
import math
import os

import duckdb


def connection(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def assert_same(df, sql, sf):
    cur = connection(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want, got = sorted_rows(cur.fetchall(), names), sorted_rows(df.collect(), df.columns)
    assert len(want) == len(got)
    bad = [(a, b) for a, b in zip(want, got) if a != b]
    assert not bad, bad[:3]
