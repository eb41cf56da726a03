"""Compares queries with their SQL on the small tables, values normalized as text."""

import datetime
import math
import os

import duckdb

DATA = os.environ.get("STRANDWELL_TEST_DATA", "/root/testdata/sf0.001")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, datetime.datetime):
        return str(v.astimezone(datetime.timezone.utc).replace(tzinfo=None) if v.tzinfo else v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def database():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def same(spark, query, sql, c):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[k]) for k in cols) for r in df.collect())
    done = c.execute(sql)
    names = [x[0] for x in done.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(k)]) for k in cols) for r in done.fetchall())
    assert got == want
