"""Runs named queries beside their SQL and compares the rows."""

import math
from collections import Counter

import duckdb


def connect(base):
    import os

    con = duckdb.connect()
    for name in sorted(os.listdir(base)):
        path = os.path.join(base, name)
        glob = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{glob}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def differences(spark, con, base, query, sql):
    got = query(spark, base)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns), (got.columns, want.columns)
    names = sorted(got.columns)
    left = Counter(tuple(canonical(r[c]) for c in names) for r in got.collect())
    order = [want.columns.index(c) for c in names]
    right = Counter(tuple(canonical(r[i]) for i in order) for r in want.fetchall())
    return left - right, right - left, sum(left.values())
