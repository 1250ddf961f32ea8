"""Models: a protocol for the user's own, and adapters over Spark ML.

A model has ``fit(train, meta)``, ``predict(samples) -> DataFrame`` with columns
``predictions_<label>``, and optionally ``score(df, meta) -> dict``.  One that lasts also has
``save(spark, folder)`` and the class method ``load(spark, folder)``.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.grid import Axis, strip_bounds
from gridloom.functions.values import one_hot
from gridloom.operators import pixels
from gridloom.operators import score as scores
from gridloom.plans import pipeline
from gridloom.sources import sidecar, tiff
from gridloom.sources.sidecar import Features, Training
from gridloom.streaming import each_batch


class MismatchedFeatures(ValueError):
    """A query's features are not those that a model was trained on."""


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _number(column: str, i: Column) -> Column:
    """An entry of an array as a double; null for what it lacks and for NaN."""
    value = F.get(column, i).cast("double")
    return F.when(~F.isnan(value), value)


class ForestModel:
    """A Spark ML forest on imputed, one-hot features of whole patches: regression for
    continuous targets, classification for categorical ones.  ``kind`` may also be gbt
    (regression) or mlp (classification)."""

    def __init__(self, kind: str = "forest", trees: int = 100, seed: int = 666, strategy: str = "mean"):
        self.kind, self.trees, self.seed, self.strategy = kind, trees, seed, strategy
        self.fitted = None

    def features(self, samples: DataFrame, meta: Features, fills: list[float]) -> DataFrame:
        """``samples`` with one vector ``features``, whatever the number of cells and bands: the continuous cells, where
        missing (null or NaN) the number of their place in ``fills``, then the one-hot categorical cells; a missing
        category is a category of its own.  The plan has the same size for one cell as for thousands."""
        cells, cats = (2 * meta.halfwidth + 1) ** 2, [c.n_values for c in meta.categorical.values()]
        parts = [F.array().cast("array<double>")]
        if meta.continuous:
            known = F.split(F.lit(",".join(map(repr, fills))), ",").cast("array<double>")  # folded into one literal
            parts.append(F.transform(_places(cells * len(meta.continuous)), lambda i: F.coalesce(_number("con", i), F.get(known, i))))
        if cats:
            widths = F.array(*[F.lit(n) for n in cats])

            def hot(i):
                n = F.get(widths, i % len(cats))
                return one_hot(F.coalesce(F.get("cat", i), n), n + 1).cast("array<double>")

            parts.append(F.flatten(F.transform(_places(cells * len(cats)), hot)))
        return samples.withColumn("features", array_to_vector(F.concat(*parts)))

    def fills(self, train: DataFrame, meta: Features) -> list[float]:
        """What stands for a missing value in each place of ``con``: its mean, median or most frequent value (the smallest
        of several), and 0 in a place without any value.  One aggregate by place, however many there are."""
        n = (2 * meta.halfwidth + 1) ** 2 * len(meta.continuous)
        if not n:
            return []
        values = F.transform(_places(n), lambda i: _number("con", i))
        by_place = train.select(F.posexplode(values).alias("place", "v")).where("v is not null")
        if self.strategy == "mode":
            by_place = by_place.groupBy("place", "v").count().groupBy("place").agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("fill"))
        else:
            by_place = by_place.groupBy("place").agg((F.avg("v") if self.strategy == "mean" else F.percentile_approx("v", 0.5, 1000)).alias("fill"))
        found = {r.place: r.fill for r in by_place.collect()}  # a row a place
        return [found.get(i, 0.0) for i in range(n)]

    def fit(self, train: DataFrame, meta: Training) -> ForestModel:
        classes, cells = meta.targets.kind == "categorical", (2 * meta.features.halfwidth + 1) ** 2
        self.fitted, self.filled = {}, {}
        for k, label in enumerate(meta.targets.labels):
            options = dict(featuresCol="features", labelCol="label", predictionCol=f"predictions_{label}")
            if self.kind == "mlp" and classes:
                width = cells * (len(meta.features.continuous) + sum(c.n_values + 1 for c in meta.features.categorical.values()))
                last = MultilayerPerceptronClassifier(layers=[width, 2 * width, meta.targets.maps[label].n_values], seed=self.seed, **options)
            elif self.kind == "gbt" and not classes:
                last = GBTRegressor(seed=self.seed, **options)
            else:
                last = (RandomForestClassifier if classes else RandomForestRegressor)(numTrees=self.trees, seed=self.seed, **options)
            known = train.withColumn("label", F.get("y", F.lit(k))).where("label is not null")
            self.filled[label] = self.fills(known, meta.features)
            self.fitted[label] = Pipeline(stages=[last]).fit(self.features(known, meta.features, self.filled[label]))
        self.meta = meta
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        out = samples
        for label, model in self.fitted.items():
            out = model.transform(self.features(out, self.meta.features, self.filled[label])).drop("features", "rawPrediction", "probability")
        kind = "int" if self.meta.targets.kind == "categorical" else "float"
        named = [F.col(f"predictions_{label}").cast(kind).alias(f"predictions_{label}") for label in self.fitted]
        return out.select(*samples.columns, *named)

    def save(self, spark: SparkSession, folder: str) -> None:
        """A folder of Spark ML pipelines, one a label, with the metadata and options; replaces
        what is there."""
        for k, model in enumerate(self.fitted.values()):
            model.write().overwrite().save(f"{folder}/label-{k}")
        sidecar.save_metadata(spark, f"{folder}/training", self.meta)
        sidecar.save_json(spark, f"{folder}/options", {"kind": self.kind, "trees": self.trees, "seed": self.seed, "strategy": self.strategy})
        sidecar.save_json(spark, f"{folder}/fills", self.filled)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ForestModel:
        out = cls(**sidecar.load_json(spark, f"{folder}/options"))
        out.meta = sidecar.load_metadata(spark, f"{folder}/training", Training)
        out.filled = sidecar.load_json(spark, f"{folder}/fills")
        out.fitted = {label: PipelineModel.load(f"{folder}/label-{k}") for k, label in enumerate(out.meta.targets.labels)}
        return out

    def score(self, predicted: DataFrame, meta: Training) -> dict[str, float]:
        return score_predictions(predicted, meta)


def score_predictions(predicted: DataFrame, meta: Training) -> dict[str, float]:
    """Accuracy or mean squared error of each label; None without rows."""
    out = {}
    for k, label in enumerate(meta.targets.labels):
        pairs = predicted.select(F.get("y", F.lit(k)).alias("a"), F.col(f"predictions_{label}").cast("double").alias("p"))
        if meta.targets.kind == "categorical":
            out[f"accuracy_{label}"] = scores.accuracy(pairs, "a", "p").first()[0]
        else:
            out[f"mse_{label}"] = scores.mean_squared_error(pairs, "a", "p").first()[0]
    return out


def predict_batches(samples: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function over batches, in parallel, by Arrow."""

    def over(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield predict(pdf)

    return samples.mapInPandas(over, schema)


def load_user_model(path: str):
    """Executes a trusted Python file that defines ``Model`` and returns the class.  Never load
    files from places that others can write to."""
    spec = importlib.util.spec_from_file_location("user_model", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.Model


def train(spark: SparkSession, data: str, model, max_points: int | None = None) -> tuple[object, dict[str, float]]:
    """Fits on the training split and scores on the test split."""
    meta = sidecar.load_metadata(spark, data, Training)
    samples = spark.read.parquet(data)
    fit_on = samples.where("split = 'train'")
    if max_points is not None:
        fit_on = pixels.take(fit_on, max_points, "row_id")
    model.fit(fit_on, meta)
    return model, model.score(model.predict(samples.where("split = 'test'")), meta)


def train_rounds(spark: SparkSession, data: str, make: Callable[[int], object], rounds: int, folder: str | None = None) -> tuple[dict, dict]:
    """Fits a model a round and keeps the best of each metric, the latest of equals; scores that
    are None or NaN never win, and a metric of no known direction is refused.

    With a ``folder`` the best model of each metric is saved there under the metric's name, and
    later calls go on after the last round that ended: its models compete with what is there.
    Returns the best models met in this call, and (step, score) of each metric over all calls.
    """
    so_far = {"next": 0, "best": {}}
    if folder and sidecar.has_json(spark, f"{folder}/rounds"):
        so_far = sidecar.load_json(spark, f"{folder}/rounds")
    best, models = so_far["best"], {}
    for step in range(so_far["next"], so_far["next"] + rounds):
        model, got = train(spark, data, make(step))
        for metric, value in got.items():
            direction = scores.LARGER_IS_BETTER.get(metric.split("_")[0])
            if direction is None:
                raise ValueError(f"whether a larger {metric} is better is not known")
            if value is None or value != value:
                continue
            last = best.get(metric, {}).get("score")
            if last is None or (value >= last if direction else value <= last):
                if folder:
                    model.save(spark, f"{folder}/{metric}")
                best[metric], models[metric] = {"step": step, "score": value}, model
        if folder:
            sidecar.save_json(spark, f"{folder}/rounds", {"next": step + 1, "best": best})
    return models, best


def predict(spark: SparkSession, model, query: str, folder: str | None = None) -> DataFrame:
    """Predictions of a strip, written as images into ``folder`` if given."""
    features = sidecar.load_metadata(spark, query, Features)
    known = model.meta.features
    if (features.bands, features.halfwidth) != (known.bands, known.halfwidth):
        raise MismatchedFeatures(f"trained on {known.bands} at {known.halfwidth}, asked for {features.bands} at {features.halfwidth}")
    out = model.predict(spark.read.parquet(query))
    if folder:
        k, n = features.strip
        labels = [c for c in out.columns if c.startswith("predictions_")]
        first = strip_bounds(features.grid.y.n, n)[k - 1][0]
        part = features.grid.strip(k, n)
        tiff.write_rasters(out.select((F.col("iy") - first).alias("y"), F.col("ix").alias("x"), *labels), part, folder, labels, f"{k}of{n}").collect()
    return out


def predict_arriving(spark: SparkSession, model, strips: str, out: str, checkpoint: str):
    """Predictions of strips that arrive as Parquet below ``strips``, one folder each; each run
    takes those that are new and stops.  A batch that is repeated replaces its own folder."""
    one = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(strips)
    stream = spark.readStream.schema(one.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(strips)

    def work(batch: DataFrame, number: int) -> None:
        model.predict(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(stream, work, checkpoint)


def predict_images(spark: SparkSession, model, folder: str, checkpoint: str, continuous: list[str] = (), categorical: list[str] = (), block: int = 1024, normalise: bool = True) -> StreamingQuery:
    """Predictions from images to images as a stream, block of rows by block of rows, each with the rows that its
    patches reach.  The images may be of another grid than those that the model was trained on, but have its bands;
    ``normalise`` as they were imported.  The query waits when all blocks are done; stopped and started again, it goes on.
    A block that is done twice replaces its images.  ``tiff.read_blocks`` reads the mosaic.
    """
    found = {k: tiff.find_rasters(spark, *v) for k, v in (("continuous", continuous), ("categorical", categorical)) if v}
    known = model.meta.features
    stream = tiff.stream_stack(spark, found.get("continuous", []), found.get("categorical", []), block, known.halfwidth)
    if set(known.bands) - set(stream.columns):
        raise MismatchedFeatures(f"trained on {known.bands}, the images have {stream.columns[4:]}")
    grid = tiff.read_header(next(iter(found.values()))[0]).grid
    features = replace(known, grid=grid, strip=(1, 1))

    def work(batch: DataFrame, number: int) -> None:
        table = batch.persist()
        for first, stop in table.select("first", "stop").distinct().collect():  # one block
            rows = pipeline.encoded_features(table.where(F.col("first") == first).drop("first", "stop"), features, normalise)
            out = model.predict(pipeline.samples_of_rows(rows, features, first, stop))
            labels = [c for c in out.columns if c.startswith("predictions_")]
            part = replace(grid, y=Axis(grid.y.origin + first * grid.y.step, grid.y.step, stop - first))
            tiff.write_rasters(out.select((F.col("iy") - first).alias("y"), F.col("ix").alias("x"), *labels), part, folder, labels, f"{first:08d}")
        table.unpersist()

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()


def save_scores(path: str, got: dict[str, float]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(got, f, indent=1, sort_keys=True)
