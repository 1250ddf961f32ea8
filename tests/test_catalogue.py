import math

import duckdb
import pytest

from gridloom.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def compare(spark, query, sql, sf):
    df = query(spark, f"/root/testdata/{sf}")
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    assert sorted(columns) == names
    place = [columns.index(n) for n in names]
    key = lambda r: [(v is None, str(v)) for v in r]
    want = sorted(([normal(r[p]) for p in place] for r in out.fetchall()), key=key)
    got = sorted(([normal(r[n]) for n in names] for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "sf0.001")
