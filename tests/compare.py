"""Runs a registered query and its DuckDB SQL on the same tables and compares the rows as multisets."""

import glob
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def assert_same(spark, name, sf_dir=SF):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    cur = duck(sf_dir).execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    left, right = as_rows(df.columns, [tuple(r) for r in df.collect()]), as_rows(names, cur.fetchall())
    assert left == right, (name, list((left - right).items())[:3], list((right - left).items())[:3])
