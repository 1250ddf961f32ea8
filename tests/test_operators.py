import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import values
from gridloom.operators import folds, patches, pixels, score, stats
from gridloom.streaming import each_batch_complete, streaming_band_stats, streaming_category_counts

# 5 x 5 image of 0..24 by rows; -1 outside.
GOLDEN = {
    (0, 0): [-1, -1, -1, -1, 0, 1, -1, 5, 6],
    (4, 4): [18, 19, -1, 23, 24, -1, -1, -1, -1],
    (0, 2): [-1, 5, 6, -1, 10, 11, -1, 15, 16],
    (2, 0): [-1, -1, -1, 1, 2, 3, 6, 7, 8],
}


@pytest.fixture(scope="module")
def image(spark):
    return spark.range(25).select((F.col("id") % 5).cast("int").alias("x"), F.floor(F.col("id") / 5).cast("int").alias("y"), F.col("id").cast("int").alias("v"), (F.col("id") * 2).alias("w"))


def centres(spark):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(GOLDEN)], "pid int, x int, y int")


@pytest.mark.parametrize("way", ["cells", "rows", "scatter"])
def test_golden_patches(spark, image, way):
    if way == "cells":
        out = patches.patch_arrays(patches.patch_cells(centres(spark), image, 1, ["v", "w"]), ["v", "w"])
    elif way == "scatter":
        out = patches.patch_scatter(image, 1, ["v", "w"], 5, 0, 5).join(centres(spark), ["x", "y"])
    else:
        out = patches.patch_rows(centres(spark), patches.pixel_rows(image, ["v", "w"], 5), 1, ["v", "w"], 5)
    rows = {r.pid: r for r in out.collect()}
    for k, want in enumerate(GOLDEN.values()):
        assert [-1 if v is None else v for v in rows[k].v] == want
        assert rows[k].v_mask == [v == -1 for v in want]
        assert [-2 if v is None else v for v in rows[k].w] == [2 * v for v in want]


def test_outside_and_missing_stay_apart(spark, image):
    holes = image.withColumn("v", F.when(F.col("v") != 6, F.col("v")))
    s = patches.patch_summary(patches.patch_cells(centres(spark), holes, 1, ["v"]), "v").orderBy("pid").first()
    assert (s.outside, s.missing, s["mean"]) == (5, 1, 2.0)
    rows = patches.patch_rows(centres(spark), patches.pixel_rows(holes, ["v"], 5), 1, ["v"], 5).orderBy("pid").first()
    assert rows.in_image == [False] * 4 + [True, True, False, True, True] and rows.v[8] is None


def test_wide_patch_on_a_narrow_image(spark):
    line = spark.createDataFrame([(0, 0, 7)], "y int, x int, v int")
    c = spark.createDataFrame([(1, 0, 0)], "pid int, x int, y int")
    a = patches.patch_arrays(patches.patch_cells(c, line, 2, ["v"]), ["v"]).first().v
    b = patches.patch_rows(c, patches.pixel_rows(line, ["v"], 1), 2, ["v"], 1).first().v
    assert a == b and a[12] == 7 and a.count(None) == 24


def test_halfwidth_zero_is_the_pixel(spark, image):
    cells = patches.patch_cells(image.select(F.col("v").alias("pid"), "x", "y"), image, 0, ["v"])
    assert cells.where("pid != v or not in_image").count() == 0 and cells.count() == 25


def test_categories(spark):
    df = spark.createDataFrame([(1, 2, 2), (1, 2, 3), (1, 1, 2), (1, 1, 1)], "a int, b int, c int")
    got = {r.band: (list(r["values"]), list(r["counts"])) for r in stats.category_arrays(stats.category_map(df, ["a", "b", "c"])).collect()}
    assert got == {"a": ([1], [4]), "b": ([1, 2], [2, 2]), "c": ([1, 2, 3], [1, 2, 1])}
    some = spark.createDataFrame([(-1,), (2,), (None,), (1,), (3,)], "v int").withColumn("v", values.from_sentinel(F.col("v"), -1))
    assert {r["value"]: r.n for r in stats.category_counts(some, ["v"]).collect()} == {1: 1, 2: 1, 3: 1}
    mapping = spark.createDataFrame([("v", 1, 0, 1), ("v", 2, 1, 1), ("v", 3, 2, 1)], "band string, value int, code int, n int")
    assert [r.v for r in stats.encoded(some, "v", mapping).collect()] == [None, 1, None, 0, 2]
    with pytest.raises(Exception, match="unknown category"):
        stats.encoded(spark.createDataFrame([(9,)], "v int"), "v", mapping).collect()
    assert stats.encoded(spark.createDataFrame([(9,)], "v int"), "v", mapping, strict=False).first().v is None


def test_statistics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e4, 3, (500, 3))
    gone = rng.random(x.shape) < 0.2
    df = spark.createDataFrame([tuple(None if g else float(v) for v, g in zip(r, m)) for r, m in zip(x, gone)], "a double, b double, c double")
    for k, r in enumerate(stats.band_stats(df, ["a", "b", "c"]).orderBy("band").collect()):
        v = x[~gone[:, k], k]
        assert r.n == len(v) and r.masked == gone[:, k].sum()
        assert math.isclose(r["mean"], v.mean(), rel_tol=1e-12) and math.isclose(r.sd, v.std(), rel_tol=1e-9)
    z = stats.band_stats(stats.normalised(df, ["a", "b"]), ["a", "b", "c"]).collect()
    assert abs(z[0]["mean"]) < 1e-9 and abs(z[1].sd - 1) < 1e-9 and z[2]["mean"] > 9000
    with pytest.raises(stats.ZeroDeviation, match="d"):
        stats.normalised(df.withColumn("d", F.lit(1.0)), ["a", "d"])
    none = stats.band_stats(df.withColumn("e", F.lit(None).cast("double")), ["e"])
    assert none.first().n == 0 and stats.check_deviation(none) == {"e": (None, None)}


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (None, "a"), (None, "b")], "v double, t string")
    assert [r.v for r in stats.mean_imputed(df, ["v"]).collect()] == [1.0, 2.0, 3.0, 2.0, 2.0]
    assert [r.t for r in stats.mode_imputed(df, "t").collect()] == ["b", "a", "a", "a", "b"]
    assert stats.mode_imputed(df.select(F.lit(None).cast("string").alias("t")), "t").where("t is null").count() == 5
    codes = spark.createDataFrame([(0,), (None,), (2,)], "c int")
    assert [r.c for r in stats.extra_category(codes, "c", 3).collect()] == [0, 3, 2]
    assert [r[0] for r in codes.select(values.one_hot(F.col("c"), 3)).collect()] == [[1, 0, 0], [0, 0, 0], [0, 0, 1]]


def test_values(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="sentinel"):
        one.select(values.to_sentinel(F.lit(-9.0), -9.0)).collect()
    assert one.select(values.from_sentinel(F.lit(float("nan")), -9.0)).first()[0] is None
    assert one.select(values.flatten_patch(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))))).first()[0] == [1, 2, 3]
    assert one.select(values.top_class(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))).first()[0] == 1
    assert one.select(values.impute_array(F.array(F.lit(1), F.lit(None)), 9)).first()[0] == [1, 9]
    names = spark.createDataFrame([("/a/b.c_x.y.tif", 2, 3), ("d.gtif", 1, 1)], "p string, b int, n int")
    assert [r[0] for r in names.select(values.band_name(F.col("p"), F.col("b"), F.col("n"))).collect()] == ["bc_xy.band2", "d"]


@pytest.mark.parametrize("n,k", [(10, 2), (123456, 10)])
def test_folds(spark, n, k):
    df = folds.with_fold(spark.range(n), k, "id")
    counts = {r.fold: r.n for r in folds.fold_counts(df, k).collect()}
    assert set(counts) == set(range(1, k + 1)) and sum(counts.values()) == n
    again = folds.with_fold(spark.range(n).repartition(7), k, "id")
    assert df.exceptAll(again).count() == 0
    if n > 1000:
        assert max(counts.values()) < 1.1 * n / k
    both = folds.split(df, 1, k)
    assert both.where("(split = 'test') != (fold = 1)").count() == 0
    assert folds.split(spark.range(3), 1, 1).count() == 6
    with pytest.raises(ValueError):
        folds.split(df, k + 1, k)


def test_subsample_and_batches(spark):
    df = spark.range(10_000)
    assert 2200 < pixels.every(df, 4, "id").count() < 2800
    rows = pixels.batch_ranges(spark.range(123), 79, "id").orderBy("batch").collect()
    assert [(r.n, r.start, r.stop) for r in rows] == [(79, 0, 79), (44, 79, 123)]
    assert pixels.repeated(spark.range(3), 4).groupBy("epoch").count().where("count = 3").count() == 4


def test_scores(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (None, 1)], "a int, p int")
    assert score.accuracy(df, "a", "p").first()["accuracy"] == pytest.approx(2 / 3)
    assert score.mean_squared_error(df, "a", "p").first()["mse"] == pytest.approx(1 / 3)
    assert score.normal_loss(df, "a", "p").first()[0] == pytest.approx(1 / 6 + 0.5 * math.log(2 * math.pi))
    probs = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.75, 0.25])], "a int, p array<double>")
    assert score.categorical_loss(probs, "a", "p").first()[0] == pytest.approx(-(math.log(0.5) + math.log(0.25)) / 2)
    s = spark.createDataFrame([(1, "mse", 3.0), (2, "mse", 1.0), (3, "mse", 1.0), (4, "mse", 2.0), (1, "accuracy", 0.5), (2, "accuracy", 0.9), (3, "accuracy", float("nan"))], "step int, metric string, score double")
    assert {r.metric: r.step for r in score.best_scores(s).collect()} == {"mse": 3, "accuracy": 2}
    kept = score.running_best(s.where("metric = 'mse'")).orderBy("step").collect()
    assert [r.kept for r in kept] == [True, True, True, False]


def test_streams_equal_batches(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.range(100).selectExpr("cast(id as double) as v", "id % 3 as c").repartition(4).write.parquet(data)
    schema = spark.read.parquet(data).schema
    got = []
    for make in (lambda d: streaming_band_stats(d, ["v"]), lambda d: streaming_category_counts(d, "c")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(data)
        q = each_batch_complete(make(stream), lambda df, n: got.append(df.collect()), str(tmp_path / f"c{len(got)}"))
        q.awaitTermination()
    by_value = [r for r in got if "value" in r[0].asDict()]
    assert {r["value"]: r.n for r in by_value[-1]} == {0: 34, 1: 33, 2: 33} and len(by_value) == 4
    last = [r for r in got if "n_v" in r[0].asDict()][-1][0]
    assert last.n_v == 100 and last.mean_v == 49.5 and reduce(max, [last.sd_v]) == pytest.approx(np.arange(100).std())


def test_offsets_and_running_best_over_many_ranges(spark, monkeypatch):
    from gridloom.operators import score

    df = spark.range(1000).where("id % 7 != 3")
    want = [tuple(r) for r in pixels.batch_ranges(df, 5, "id").orderBy("batch").collect()]
    scores = spark.range(300).selectExpr("id as step", "case when id % 3 = 0 then 'mse' else 'r2' end as metric", "cast((id * 7919) % 101 as double) as score")
    kept = {r.step: r.kept for r in score.running_best(scores).collect()}
    monkeypatch.setattr(pixels, "GROUP", 7)
    monkeypatch.setattr(score, "STEPS", 10)
    assert [tuple(r) for r in pixels.batch_ranges(df, 5, "id").orderBy("batch").collect()] == want
    assert {r.step: r.kept for r in score.running_best(scores).collect()} == kept
    assert [r[2] for r in want[1:]] == [r[3] for r in want[:-1]] and want[-1][3] == df.count()


def test_scratch_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from gridloom import shipping
    from gridloom.sources import workspace

    for master, good in (("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        sc = SimpleNamespace(master=master, applicationId=f"app-{master}")
        shipping._shipped.add(sc.applicationId)
        session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
        if good:
            assert workspace.scratch_root(session) == workspace.scratch_root(session)
        else:
            with pytest.raises(RuntimeError, match="share"):
                workspace.scratch_root(session)


@pytest.mark.parametrize("h", range(6))
def test_patches_by_overlapping_blocks(spark, h):
    """As by sending every pixel to its patches, on a grid with holes; pixels travel about once."""
    rnd, width, height, side = random.Random(h), 23, 19, 7
    rows = [(y, x, rnd.choice([None, float(x)]), rnd.choice([None, y * 100 + x])) for y in range(height) for x in range(width) if rnd.random() < 0.8]
    image = spark.createDataFrame(rows, "y int, x int, `a.b` float, c int")
    names, cut = ["a.b", "c"], (4, 15)
    want = patches.patch_scatter(image, h, names, width, *cut)
    got = patches.patch_blocks(image, h, names, width, *cut, side=side)
    assert sorted(map(str, got.select(*[f"`{c}`" for c in want.columns]).collect())) == sorted(map(str, want.collect()))
    if h:
        sent = patches.dealt_to_blocks(image, h, names, width, *cut, side).count()
        assert sent <= len(rows) * (1 + 2 * h / side) ** 2 * 1.3 and (h == 1 or sent < len(rows) * (2 * h + 1) ** 2 / 3)
    assert patches.patch_blocks(image.limit(0), h, names, width, *cut).count() == 0
