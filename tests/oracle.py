"""Compare a query with its SQL on the smallest supplied tables."""

import decimal
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HAVE = os.path.exists(f"{DATA}/documents.parquet")


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return "nan" if value != value else repr(value + 0.0) if isinstance(value, float) else str(value)


def differs(spark, query, sql):
    """Rows that only one side has."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[k]) for k in at) for r in result.fetchall())
    return list((got - want).elements())[:3], list((want - got).elements())[:3], got.total() - want.total()
