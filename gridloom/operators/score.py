"""Scores of predictions, and the best model so far."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Whether larger is better, by metric.
LARGER_IS_BETTER = {"accuracy": True, "r2": True, "f1": True, "mse": False, "loss": False, "nll": False}


#: Steps of one range of ``running_best``.
STEPS = 100_000


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.col(actual) == F.col(predicted)).alias("n"))


def mean_squared_error(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    d = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.agg(F.avg(d * d).alias("mse"), F.count(d).alias("n"))


def normal_loss(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean negative log-likelihood of a normal distribution of scale 1."""
    d = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.agg(F.avg(0.5 * d * d + 0.5 * log(2 * pi)).alias("nll"))


def categorical_loss(df: DataFrame, actual: str, probabilities: str) -> DataFrame:
    """Mean negative log-probability of the actual class in an array of probabilities."""
    return df.agg(F.avg(-F.log(F.get(probabilities, F.col(actual)))).alias("nll"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def signed_score(directions: dict[str, bool] | None):
    """The score of ``metric``, negative where less is better."""
    sign = F.lit(1.0)
    for name, larger in {**LARGER_IS_BETTER, **(directions or {})}.items():
        sign = F.when(F.col("metric") == name, F.lit(1.0 if larger else -1.0)).otherwise(sign)
    return sign * F.col("score")


def best_scores(scores: DataFrame, directions: dict[str, bool] | None = None) -> DataFrame:
    """From rows (step, metric, score): the best step of each metric, the latest of equals.
    NaN and NULL scores never win."""
    good = scores.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    rank = F.struct(signed_score(directions), F.col("step"))
    return good.groupBy("metric").agg(F.max_by("step", rank).alias("step"), F.max_by("score", rank).alias("score"))


def running_best(scores: DataFrame, directions: dict[str, bool] | None = None) -> DataFrame:
    """Each step with ``kept``: whether its model replaces the best so far of its metric.

    Best scores of ranges of STEPS steps run on over the ranges, and steps within their range,
    so that a metric of very many steps is not one task's.
    """
    signed = scores.withColumns({"_signed": signed_score(directions), "_range": F.floor(F.col("step") / STEPS)})
    before = lambda value, w: F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    ranges = signed.groupBy("metric", "_range").agg(F.max("_signed").alias("_best"))
    ranges = ranges.select(F.col("metric").alias("_metric"), F.col("_range").alias("_at"), before("_best", W.partitionBy("metric").orderBy("_range")).alias("_base"))
    joined = signed.join(ranges, F.col("metric").eqNullSafe(F.col("_metric")) & F.col("_range").eqNullSafe(F.col("_at")))
    best = F.greatest(F.col("_base"), before("_signed", W.partitionBy("metric", "_range").orderBy("step")))
    return joined.select(*scores.columns, F.coalesce(F.col("_signed") >= best, F.lit(True)).alias("kept"))
