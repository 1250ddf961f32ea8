"""Generating, sampling and reading pixels of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import GridSpec, pixel_index, pixel_position, strip_bounds, strip_number
from gridloom.operators import ranking

#: Batches of which one range's offsets are summed up in one place.
GROUP = 100_000


def all_pixels(spark: SparkSession, grid: GridSpec, strip: int = 1, strips: int = 1) -> DataFrame:
    """Rows (pixel, x, y) of one strip in row-major numbering of the whole grid; a range is
    generated in parallel and holds nothing but its own strip."""
    if not 1 <= strip <= strips:
        raise ValueError(f"strip {strip} of {strips}")
    start, stop = strip_bounds(grid.y.n, strips)[strip - 1]
    return _unravelled(spark.range(start * grid.x.n, stop * grid.x.n).withColumnRenamed("id", "pixel"), grid)


def _unravelled(df: DataFrame, grid: GridSpec) -> DataFrame:
    return df.select("*", (F.col("pixel") % grid.x.n).cast("int").alias("x"), F.floor(F.col("pixel") / grid.x.n).cast("int").alias("y"))


def keyed_order(id_col, seed: int, arithmetic: bool = False):
    """A number that orders rows at random, by id and seed alone.

    ``arithmetic`` is a plain multiplicative hash that any SQL engine can repeat; the default
    mixes better.
    """
    if arithmetic:
        return (F.col(id_col).cast("long") * 2654435761 + seed) % 4294967296
    return F.xxhash64(F.lit(seed), F.col(id_col))


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 666, arithmetic: bool = False) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all if there are fewer; the same ones however ``df``
    is partitioned, in no order.  Rows with one id are drawn one after the other."""
    return ranking.smallest(df, keyed_order(id_col, seed, arithmetic), n, id_col)


def sample_pixels(spark: SparkSession, grid: GridSpec, n: int, seed: int = 666) -> DataFrame:
    """``n`` distinct pixels of a grid."""
    if n > grid.pixels:
        raise ValueError(f"{n} pixels of {grid.pixels}")
    return sample_rows(all_pixels(spark, grid), n, "pixel", seed)


def shuffled(df: DataFrame, id_col: str, seed: int = 666, arithmetic: bool = False) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(keyed_order(id_col, seed, arithmetic), id_col)


def every(df: DataFrame, step: int, id_col: str, seed: int = 666, arithmetic: bool = False) -> DataFrame:
    """About one row in ``step`` of a random order, chosen by hash and so without a sort."""
    return df.where(F.pmod(keyed_order(id_col, seed, arithmetic), F.lit(step)) == 0)


def take(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in an explicit order; None takes all, 0 none.  Of a whole-numbered order of one
    column they are found by its threshold and come in no order; of any other, rows are numbered
    by range."""
    if n is None:
        return df
    kind = dict(df.dtypes).get(order[0]) if order and isinstance(order[0], str) else None
    if len(order) == 1 and kind in ("tinyint", "smallint", "int", "bigint"):
        return ranking.smallest(df, F.col(order[0]), n, order[0])
    return ranking.numbered(df, *order, out="_place").where(F.col("_place") < n).drop("_place")


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once for each epoch, numbered from 0, without a shuffle."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def batched(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """Rows with the number of their batch of consecutive ids."""
    return df.withColumn("batch", F.floor(F.col(id_col) / F.lit(size)).cast("long"))


def batch_ranges(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """One row per batch: its rows, and its half-open range in the stacked rows.

    Batches sum up within ranges of GROUP batches each; only the ranges' totals pass one window.
    """
    from pyspark.sql import Window as W

    counts = batched(df, size, id_col).groupBy("batch").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("batch") / GROUP))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    earlier = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("group", earlier("total", W.orderBy("group")).alias("base"))
    placed = counts.join(bases, "group").withColumn("start", F.col("base") + earlier("n", W.partitionBy("group").orderBy("batch")))
    return placed.select("batch", "n", "start", (F.col("start") + F.col("n")).alias("stop"))


def located(points: DataFrame, grid: GridSpec, x_col: str, y_col: str, outside: str = "error") -> DataFrame:
    """``points`` with ``ix`` and ``iy``; ``outside`` is error, null or drop."""
    policy = "null" if outside == "drop" else outside
    out = points.withColumns({"ix": pixel_index(F.col(x_col), grid.x, policy), "iy": pixel_index(F.col(y_col), grid.y, policy)})
    return out.where("ix is not null and iy is not null") if outside == "drop" else out


def positioned(pixels: DataFrame, grid: GridSpec, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """``pixels`` with ``cx`` and ``cy``, their leading edges."""
    return pixels.withColumns({"cx": pixel_position(F.col(x_col), grid.x), "cy": pixel_position(F.col(y_col), grid.y)})


def with_strip(pixels: DataFrame, rows: int, strips: int, y_col: str = "y") -> DataFrame:
    return pixels.withColumn("strip", strip_number(F.col(y_col), rows, strips))


def in_strip(pixels: DataFrame, rows: int, strip: int, strips: int, y_col: str = "y") -> DataFrame:
    """Rows of one strip, as a range predicate that reaches the scan."""
    start, stop = strip_bounds(rows, strips)[strip - 1]
    return pixels.where((F.col(y_col) >= start) & (F.col(y_col) < stop))


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bands of registered images side by side, joined on pixel; band names must differ."""
    names = [c for df in (first, *others) for c in df.columns if c not in ("x", "y")]
    if len(set(names)) < len(names):
        raise ValueError(f"band names repeat: {sorted({n for n in names if names.count(n) > 1})}")
    out = first
    for df in others:
        out = out.join(df, ["y", "x"])
    return out


def row_ranges(rows: DataFrame, y_col: str = "y") -> DataFrame:
    """Maximal half-open ranges of consecutive values of ``y_col``.

    Edges of ranges are found by two anti joins on the value, so that no window runs over all
    rows; only edges are numbered.
    """
    from pyspark.sql import Window as W

    y = rows.select(F.col(y_col).cast("long").alias("y")).where("y is not null").distinct()
    starts = y.join(y.select((F.col("y") + 1).alias("y")), "y", "left_anti").select("y", F.lit(0).alias("end"))
    stops = y.select((F.col("y") + 1).alias("y")).join(y, "y", "left_anti").select("y", F.lit(1).alias("end"))
    pairs = starts.union(stops).withColumn("stop", F.lead("y").over(W.orderBy("y", F.desc("end"))))
    return pairs.where("end = 0").select(F.col("y").alias("start"), "stop")
