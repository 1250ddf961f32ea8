import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["row_id", "ix", "iy", "cells", "mean_z"]
