import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import pixels, ranking, stats


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_follow_the_order(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(40), rnd.choice("abc")) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, v int, key string").repartition(7)
    got = ranking.numbered(df, F.desc("v"), "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == [k for k, *_ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    got = ranking.within(df.withColumn("_key", F.lit(1)).drop("_key"), "key", "v", "id").collect()
    for key in "abc":
        of = sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0]))
        assert [r.id for r in sorted((r for r in got if r.key == key), key=lambda r: r.number)] == [k for k, *_ in of]
    assert ranking.numbered(df.limit(0), "id").count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 37, 38, 60, 199, 200, 500])
def test_smallest_with_ties_extremes_and_nulls(spark, n):
    rnd = random.Random(n)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, None]
    rows = [(k, rnd.choice([*ends, rnd.randrange(-(1 << 62), 1 << 62), 7, 7, 7])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, v long")
    low = lambda v: -(1 << 63) if v is None else v
    want = sorted(rows, key=lambda r: (low(r[1]), r[0]))[:n]
    got = ranking.smallest(df, F.col("v"), n, "id")
    assert sorted(r.id for r in got.collect()) == sorted(k for k, _ in want)


def test_samples_neither_limit_nor_sort(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    chosen = pixels.sample_rows(df, 300, "id", 5)
    assert chosen.count() == 300 and "Limit" not in plan_of(chosen) and "TakeOrdered" not in plan_of(chosen)
    assert {r.id for r in chosen.collect()} == {r.id for r in pixels.sample_rows(df.repartition(3), 300, "id", 5).collect()}
    same = spark.range(90).select((F.col("id") % 3).alias("id"), F.col("id").alias("v"))  # ids that repeat
    assert pixels.sample_rows(same, 40, "id").count() == 40 and pixels.sample_rows(same, 100, "id").count() == 90
    assert sorted(r.id for r in pixels.take(same, 35, "id").collect()) == [0] * 30 + [1] * 5
    assert [r.v for r in pixels.take(df, 3, F.desc("v")).orderBy("v").collect()] == [9994, 9996, 9998]


def test_dictionaries_of_many_values(spark):
    df = spark.range(30_000).select((F.col("id") * 7 % 20_011).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("b"))
    got = stats.category_map(df, ["a", "b"])
    assert "Window" not in plan_of(got)
    rows = got.collect()
    assert sorted((r.value, r.code) for r in rows if r.band == "b") == [(0, 0), (1, 1), (2, 2)]
    values = sorted({k * 7 % 20_011 for k in range(30_000)})
    assert sorted((r.value, r.code) for r in rows if r.band == "a") == list(zip(values, range(len(values))))
