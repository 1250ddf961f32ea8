import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import sizing
from gridloom.functions.grid import Axis, GridSpec, edge, in_box, pixel_index, pixel_index_among, pixel_position, strip_bounds, strip_number
from gridloom.operators import pixels


def searched(points, edges):
    """The pixel of each point by search among the edges."""
    up = edges if edges[0] < edges[-1] else edges[::-1]
    n = len(edges) - 1
    if up is edges:
        i = np.searchsorted(edges, points, side="right") - 1
        return np.where(points == edges[-1], n - 1, i)
    i = np.array([max(k for k in range(n + 1) if edges[k] >= p) for p in points])
    return np.minimum(i, n - 1)


def test_pixel_of_point_for_random_axes(spark):
    rng = np.random.default_rng(666)
    for _ in range(12):
        axis = Axis(rng.uniform(-10, 10), float(rng.uniform(0.01, 5) * rng.choice([-1, 1])), int(rng.integers(1, 200)))
        edges = np.array(axis.edges())
        points = np.r_[edges, (edges[1:] + edges[:-1]) / 2, rng.uniform(edges.min(), edges.max(), 200)]
        df = spark.createDataFrame([(k, float(p)) for k, p in enumerate(points)], "k int, p double")
        up = F.array(*[F.lit(float(e)) for e in sorted(edges)])
        rows = df.select("k", pixel_index(F.col("p"), axis).alias("i"), pixel_index_among(F.col("p"), up).alias("j")).orderBy("k").collect()
        assert [r.i for r in rows] == searched(points, edges).tolist()
        assert [r.j for r in rows] == searched(points, np.sort(edges)).tolist()
        back = spark.range(axis.n + 1).select(edge(F.col("id"), axis).alias("e")).collect()
        assert [r.e for r in back] == edges.tolist()


def test_outside_policies(spark):
    axis = Axis(0.0, 1.0, 3)
    df = spark.createDataFrame([(-0.1,), (3.0,), (3.1,), (float("nan"),), (None,)], "p double")
    assert [r[0] for r in df.select(pixel_index(F.col("p"), axis, "null")).collect()] == [None, 2, None, None, None]
    with pytest.raises(Exception, match="outside the grid"):
        df.select(pixel_index(F.col("p"), axis)).collect()
    assert df.where("p is null").select(pixel_index(F.col("p"), axis)).first()[0] is None
    with pytest.raises(Exception, match="outside the grid"):
        spark.range(4).select(pixel_position(F.col("id"), axis)).collect()
    located = pixels.located(df.withColumn("q", F.lit(1.0)), GridSpec(axis, axis), "p", "q", "drop")
    assert located.count() == 1
    with pytest.raises(ValueError):
        pixel_index(F.col("p"), axis, "other")


def test_closed_box_and_reversed_edges(spark):
    points = [(1, 1, True), (-1, 3, False), (3, -1, False), (8, 7, False), (0, 0, True), (9, 4, True), (10, 10, False)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y, _ in points], "x double, y double")
    for grid in (GridSpec(Axis(0, 1, 9), Axis(0, 1, 4)), GridSpec(Axis(9, -1, 9), Axis(4, -1, 4))):
        assert [r[0] for r in df.select(in_box(F.col("x"), F.col("y"), grid.box)).collect()] == [p[2] for p in points]


@pytest.mark.parametrize("total,n", [(100, 4), (10, 10), (7, 2), (8, 1), (101, 4)])
def test_strips(spark, total, n):
    bounds = strip_bounds(total, n)
    assert bounds[0][0] == 0 and bounds[-1][1] == total and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    got = spark.range(total).selectExpr("id", f"ntile({n}) over (order by id) as t").withColumn("s", strip_number(F.col("id"), total, n))
    assert got.where("t != s").count() == 0
    grid = GridSpec(Axis(0, 1, 3), Axis(5, -0.5, total), {"a": "b"})
    parts = [grid.strip(k + 1, n) for k in range(n)]
    assert sum(p.y.n for p in parts) == total and all(p.x == grid.x and p.crs == grid.crs for p in parts)
    edges = [e for p in parts for e in p.y.edges()[:-1]] + [grid.y.edges()[-1]]
    assert np.allclose(edges, grid.y.edges())
    with pytest.raises(ValueError):
        strip_bounds(2, 3)


def test_pixels_and_samples(spark):
    grid = GridSpec(Axis(0, 1, 10), Axis(0, 1, 20))
    rows = pixels.all_pixels(spark, grid).orderBy("pixel").collect()
    assert [(r.x, r.y) for r in rows] == [(x, y) for y in range(20) for x in range(10)]
    one = [r.pixel for r in pixels.sample_pixels(spark, grid, 50, 3).collect()]
    assert len(set(one)) == 50 and one == [r.pixel for r in pixels.sample_pixels(spark, grid, 50, 3).collect()]
    assert one != [r.pixel for r in pixels.sample_pixels(spark, grid, 50, 4).collect()]
    with pytest.raises(ValueError):
        pixels.sample_pixels(spark, grid, 201)
    assert pixels.take(spark.range(5), 0, "id").count() == 0 and pixels.take(spark.range(5), None).count() == 5


def test_row_ranges(spark):
    df = spark.createDataFrame([(y,) for y in (3, 1, 2, 2, 7, 9, 10, None)], "y int")
    assert sorted((r.start, r.stop) for r in pixels.row_ranges(df).collect()) == [(1, 4), (7, 8), (9, 11)]
    assert pixels.row_ranges(df.limit(0)).count() == 0


def test_stacked_refuses_repeated_names(spark):
    a = spark.createDataFrame([(0, 0, 1)], "y int, x int, a int")
    with pytest.raises(ValueError, match="repeat"):
        pixels.stacked(a, a)


def test_sizing():
    assert sizing.points_for(1, 2, 1, 0) == round(1e6 / (4 * 3 + 16)) and sizing.points_for(1e-9, 1, 1) == 1
    assert sizing.rows_for(10, 100, 5, 5) == round(10e6 / 40 / 100)
