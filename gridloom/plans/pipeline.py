"""Import, extract, train and predict: each step one declarative plan.

Tables are Parquet with a JSON sidecar.  A feature table has (y, x, bands...); a sample has
the arrays ``con``, ``con_mask``, ``cat``, ``cat_mask`` of its patch (bands within cells, cells
in row-major order), its pixel (ix, iy), position (cx, cy) and, for training, ``y``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import GridSpec, strip_bounds
from gridloom.operators import folds, patches, pixels, stats
from gridloom.sources import sidecar, tiff
from gridloom.sources.sidecar import Categorical, Continuous, Features, Targets, Training
from gridloom.sources.workspace import scratch_folder


def import_rasters(spark: SparkSession, out: str, continuous: list[str] = (), categorical: list[str] = (), normalise: bool = True, ignore_crs: bool = False) -> Features:
    """Files or folders of images into one feature table.  Images are decoded once, into a
    scratch table, which statistics, categories and the encoded table are made from."""
    found = {k: tiff.find_rasters(spark, *v) for k, v in (("continuous", continuous), ("categorical", categorical)) if v}
    if not found:
        raise tiff.NoRasters("neither continuous nor categorical images")
    grid = tiff.registered(spark, [p for paths in found.values() for p in paths], ignore_crs)
    frames = {k: tiff.read_stack(spark, paths, k, ignore_crs) for k, paths in found.items()}
    table = _written(pixels.stacked(*frames.values()), "pixels")
    bands = [bands_of(frames.get(k)) for k in ("continuous", "categorical")]
    mapping = _written(stats.category_map(table, bands[1]), "categories") if bands[1] else None
    features = describe(table, grid, *bands, normalise=normalise, mapping=mapping)
    save_features(table, features, out, normalise, mapping)
    return features


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bands_of(df: DataFrame | None) -> list[str]:
    return [c for c in df.columns if c not in ("y", "x")] if df is not None else []


def describe(table: DataFrame, grid: GridSpec, continuous: list[str], categorical: list[str], normalise: bool = True, mapping: DataFrame | None = None) -> Features:
    """Metadata of a pixel table.  One row a band and the categories reach the driver, of which
    there may be ``stats.MAX_BROADCAST_CATEGORIES``."""
    features = Features(grid)
    if continuous:
        rows = stats.band_stats(table, continuous)
        known = stats.check_deviation(rows) if normalise else {}
        features.continuous = {b: Continuous(*known.get(b, (None, None))) for b in continuous}
    if categorical:
        arrays = _arrays(mapping if mapping is not None else stats.category_map(table, categorical))
        features.categorical = {b: Categorical(list(arrays[b]["values"]), list(arrays[b]["counts"])) if b in arrays else Categorical() for b in categorical}
    return features


def _arrays(mapping: DataFrame) -> dict:
    n = mapping.count()
    if n > stats.MAX_BROADCAST_CATEGORIES:
        raise ValueError(f"{n} categories are more than metadata can hold")
    return {r.band: r for r in stats.category_arrays(mapping).collect()}


def save_features(table: DataFrame, features: Features, out: str, normalise: bool = True, mapping: DataFrame | None = None) -> None:
    if mapping is None and features.categorical:
        mapping = stats.category_map(table, list(features.categorical))
    sidecar.save_table(encoded_features(table, features, normalise, mapping), out, features)


def encoded_features(table: DataFrame, features: Features, normalise: bool = True, mapping: DataFrame | None = None) -> DataFrame:
    """Continuous bands of a pixel table as z-scores and categorical ones as codes; by default those of the metadata's
    own dictionaries, in which every value must be."""
    known = {b: c for b, c in features.continuous.items() if normalise and c.mean is not None}
    done = table.withColumns({b: ((F.col(f"`{b}`").cast("double") - c.mean) / c.sd).cast("float") for b, c in known.items()})
    if mapping is None and features.categorical:
        rows = [(b, int(v), k) for b, c in features.categorical.items() for k, v in enumerate(c.values)]
        mapping = table.sparkSession.createDataFrame(rows, "band string, value int, code int")
    for b in features.categorical:
        done = stats.encoded(done, b, mapping)
    return done


def import_targets(points: DataFrame, out: str, labels: list[str], kind: str = "continuous", normalise: bool = False, every: int = 1, seed: int = 666) -> Targets:
    """Points (row_id, x, y, labels...) into a target table in random order, one in ``every``."""
    spark = points.sparkSession
    chosen = pixels.every(points, every, "row_id", seed) if every > 1 else points
    chosen = chosen.select("row_id", "x", "y", *labels)
    meta = Targets(labels, kind, 0)
    if kind == "continuous":
        known = stats.check_deviation(stats.band_stats(chosen, labels)) if normalise else {}
        chosen = stats.normalised(chosen, labels) if normalise else chosen
        meta.stats = {b: Continuous(*known.get(b, (None, None))) for b in labels}
    else:
        mapping = _written(stats.category_map(chosen, labels), "categories")
        arrays = _arrays(mapping)
        meta.maps = {b: Categorical(list(arrays[b]["values"]), list(arrays[b]["counts"])) if b in arrays else Categorical() for b in labels}
        for b in labels:
            chosen = stats.encoded(chosen, b, mapping)
    meta.n = chosen.count()
    pixels.shuffled(chosen, "row_id", seed).write.mode("overwrite").parquet(out)
    sidecar.save_metadata(spark, out, meta)
    return meta


def gathered(centres: DataFrame, table: DataFrame, features: Features) -> DataFrame:
    """``centres`` (with ix, iy) and the arrays of their patches.  A pixel's patch is read once, however many
    centres lie in it, and whatever their ids are."""
    con, cat = list(features.continuous), list(features.categorical)
    pixel = F.col("iy").cast("long") * features.grid.x.n + F.col("ix")
    asked = centres.where("ix is not null and iy is not null").select(pixel.alias("_pixel"), "ix", "iy").dropDuplicates(["_pixel"])
    cells = patches.patch_cells(asked, table, features.halfwidth, features.bands, "_pixel", "ix", "iy")
    found = _by_cell(patches.patch_arrays(cells, features.bands, "_pixel"), con, cat, ["_pixel"])
    return centres.withColumn("_pixel", pixel).join(found, "_pixel", "left").drop("_pixel")


def _by_cell(arrays: DataFrame, con: list[str], cat: list[str], keys: list[str]) -> DataFrame:
    """``con``, ``cat`` and their masks from an array for each band: bands within cells."""

    def flat(bands: list[str], kind: str):
        zipped = F.arrays_zip(*[F.col(f"`{b}`").alias(f"v{i}") for i, b in enumerate(bands)]) if bands else None
        cell = lambda s: F.array(*[s[f"v{i}"] for i in range(len(bands))]).cast(f"array<{kind}>")
        return F.flatten(F.transform(zipped, cell)) if bands else F.array().cast(f"array<{kind}>")

    one = arrays.select(*keys, flat(con, "float").alias("con"), flat(cat, "int").alias("cat"))
    return one.select("*", *[F.transform(c, F.isnull).alias(f"{c}_mask") for c in ("con", "cat")])


def extract_traintest(spark: SparkSession, features_path: str, targets_path: str, out: str, test_fold: int = 1, nfolds: int = 10, seed: int = 666, halfwidth: int = 0, outside: str = "error", arithmetic: bool = False) -> Training:
    """Samples of all targets, in partitions ``split=train`` and ``split=test``; ``arithmetic``
    folds can be repeated by any SQL engine."""
    features, targets = sidecar.load_metadata(spark, features_path, Features), sidecar.load_metadata(spark, targets_path, Targets)
    features.halfwidth = halfwidth
    table, points = spark.read.parquet(features_path), spark.read.parquet(targets_path)
    centres = pixels.located(points, features.grid, "x", "y", outside)
    y = F.array(*[F.col(f"`{b}`").cast("double") for b in targets.labels])
    if outside == "null":  # points outside have no sample
        centres = centres.where("ix is not null and iy is not null")
    centres = centres.select("row_id", "ix", "iy", F.col("x").alias("cx"), F.col("y").alias("cy"), y.alias("y"))
    samples = folds.split(folds.with_fold(gathered(centres, table, features), nfolds, "row_id", seed, arithmetic), test_fold, nfolds)
    samples.write.mode("overwrite").partitionBy("split").parquet(out)
    counts = {r.fold: r.n for r in folds.fold_counts(folds.with_fold(centres, nfolds, "row_id", seed, arithmetic), nfolds).collect()}
    training = Training(features, targets, nfolds, test_fold, counts)
    sidecar.save_metadata(spark, out, training)
    return training


def extract_query(spark: SparkSession, features_path: str, out: str, strip: int = 1, strips: int = 1, halfwidth: int = 0) -> Features:
    """Samples of all pixels of a strip.  Patches may reach into other strips, so that strips
    join without seams; only the rows they reach are read."""
    features = sidecar.load_metadata(spark, features_path, Features)
    features.halfwidth, features.strip = halfwidth, (strip, strips)
    start, stop = strip_bounds(features.grid.y.n, strips)[strip - 1]
    samples_of_rows(spark.read.parquet(features_path), features, start, stop).write.mode("overwrite").parquet(out)
    sidecar.save_metadata(spark, out, features)
    return features


def samples_of_rows(table: DataFrame, features: Features, start: int, stop: int) -> DataFrame:
    """Samples of all pixels of the rows [start, stop), from a feature table with the rows that their patches reach."""
    arrays = patches.patch_blocks(table, features.halfwidth, features.bands, features.grid.x.n, start, stop)
    cells = _by_cell(arrays, list(features.continuous), list(features.categorical), ["y", "x"])
    placed = pixels.positioned(cells.withColumn("pixel", F.col("y").cast("long") * features.grid.x.n + F.col("x")), features.grid)
    return placed.select("pixel", F.col("x").alias("ix"), F.col("y").alias("iy"), "cx", "cy", "con", "cat", "con_mask", "cat_mask")


class FeatureReader:
    """Samples straight from a feature table."""

    def __init__(self, spark: SparkSession, path: str, halfwidth: int = 0):
        self.spark, self.features = spark, sidecar.load_metadata(spark, path, Features)
        self.features.halfwidth = halfwidth
        self.table = spark.read.parquet(path)

    def __len__(self) -> int:
        return self.features.grid.pixels

    @property
    def crs(self) -> dict[str, str]:
        return self.features.grid.crs

    def read(self, n: int | None = None, shuffle: bool = False, seed: int = 666) -> DataFrame:
        """The first, or random, ``n`` pixels; None reads all and 0 none.  Shuffled rows come in
        a random order."""
        if not shuffle:
            chosen = pixels.take(pixels.all_pixels(self.spark, self.features.grid), n, "pixel")
            return self.read_ix(chosen.select("x", "y"))
        chosen = pixels.all_pixels(self.spark, self.features.grid) if n is None else pixels.sample_pixels(self.spark, self.features.grid, n, seed)
        return pixels.shuffled(self.read_ix(chosen.select("x", "y")), "pixel", seed)

    def read_ix(self, indices: DataFrame, outside: str = "error") -> DataFrame:
        """By pixel columns (x, y): one row for each row of ``indices``, with its other columns.
        Pixels asked for repeatedly are read once.  An index outside the grid is an error, or its
        row is dropped (``drop``) or comes without a pixel (``null``), as one with a null index does."""
        w, h = self.features.grid.x.n, self.features.grid.y.n
        x, y = F.col("x").cast("long"), F.col("y").cast("long")
        inside = x.between(0, w - 1) & y.between(0, h - 1)
        if outside == "drop":
            indices = indices.where(inside)
        elif outside == "error":
            told = F.concat(F.lit("outside the grid: "), x.cast("string"), F.lit(", "), y.cast("string"))
            inside = F.when(inside, True).when(inside.isNotNull(), F.raise_error(told).cast("boolean"))
        elif outside != "null":
            raise ValueError(f"outside must be 'error', 'null' or 'drop', not {outside!r}")
        asked = indices.withColumn("_inside", inside)
        held = lambda c: F.when(F.col("_inside"), c.cast("int"))
        placed = pixels.positioned(asked.withColumns({"ix": held(x), "iy": held(y)}), self.features.grid, "ix", "iy")
        pixel = F.col("iy").cast("long") * w + F.col("ix")
        return gathered(placed.drop("x", "y", "_inside").withColumn("pixel", pixel), self.table, self.features)

    def read_coords(self, points: DataFrame, outside: str = "error") -> DataFrame:
        """By world columns (x, y): one row for each point within the grid, with its other columns;
        ``outside`` as in ``read_ix``."""
        found = pixels.located(points, self.features.grid, "x", "y", outside)
        return self.read_ix(found.drop("x", "y").withColumnsRenamed({"ix": "x", "iy": "y"}), outside)
