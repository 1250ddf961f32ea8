"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from gridloom.operators.score import signed_score
from gridloom.shipping import ship

#: Keyed state of a user's own needs this store of Spark's.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_band_stats(stream: DataFrame, bands: list[str]) -> DataFrame:
    """Running count, mean and population deviation of bands; use output mode ``complete``.
    The state is one row."""
    aggs = [f(F.col(b).cast("double")).alias(f"{name}_{b}") for b in bands for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]
    return stream.agg(*aggs)


def streaming_category_counts(stream: DataFrame, band: str) -> DataFrame:
    """Running counts of values; the state is a row for each value.  Output mode ``update`` or
    ``complete``."""
    return stream.where(F.col(band).isNotNull()).groupBy(F.col(band).alias("value")).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on the batches that are there and stops; begun again, it goes on with new
    files only.  For strips that arrive as files."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch_complete(aggregated: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """As ``each_batch`` for an aggregate, whose whole state each batch hands over."""
    writer = aggregated.writeStream.outputMode("complete").foreachBatch(work)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch_update(keyed: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """As ``each_batch`` for the streams below, which keep a state a key: each batch hands over the keys that changed."""
    conf, name = keyed.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STORE)
    try:
        writer = keyed.writeStream.outputMode("update").foreachBatch(work)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def _best_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["rank", "step"]).groupby("metric", dropna=False, sort=False).tail(1)


class _BestOfMetric(StatefulProcessor):
    """State of a metric: rank, step and score of the best so far."""

    def init(self, handle) -> None:
        self.best = handle.getValueState("best", "rank double, step long, score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.best.get()) if self.best.exists() else None
        new = old
        for pdf in rows:
            for rank, step, score in zip(pdf["rank"], pdf["step"], pdf["score"]):
                if new is None or (rank, step) > new[:2]:
                    new = (float(rank), int(step), float(score))
        if new != old:
            self.best.update(new)
            yield pd.DataFrame({"metric": [key[0]], "step": [new[1]], "score": [new[2]]})

    def close(self) -> None:
        pass


def streaming_best(stream: DataFrame, directions: dict[str, bool] | None = None) -> DataFrame:
    """From rows (step, metric, score): a row (metric, step, score) for each batch and metric whose best score so far,
    the latest step of equals, the batch replaces.  Rows without step and NaN and NULL scores never win.

    The state is a row a metric.  Tasks send on the best of each metric in their batches of rows only, so that a
    metric of very many rows is not one task's.  For ``each_batch_update``.
    """
    ship(stream.sparkSession)
    value = F.col("score").cast("double")
    good = stream.where(value.isNotNull() & ~F.isnan(value) & F.col("step").isNotNull())
    ranked = good.select(F.col("metric").cast("string").alias("metric"), F.col("step").cast("long").alias("step"), value.alias("score"), signed_score(directions).alias("rank"))
    fewer = ranked.mapInPandas(lambda pdfs: map(_best_rows, pdfs), "metric string, step long, score double, rank double")
    return fewer.groupBy("metric").transformWithStateInPandas(_BestOfMetric(), "metric string, step long, score double", "Update", "None")


def _moments(pdf: pd.DataFrame) -> pd.DataFrame:
    groups = pdf.groupby("band", sort=False)["v"]
    out = groups.agg(n="count", mean="mean", m2=lambda v: float(((v - v.mean()) ** 2).sum())).reset_index()
    return out[["band", "n", "mean", "m2"]]


class _MomentsOfBand(StatefulProcessor):
    """State of a band: count, mean and sum of squared deviations."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0)
        for pdf in rows:
            for k, other, part in zip(pdf["n"], pdf["mean"], pdf["m2"]):
                both = n + int(k)
                m2 += float(part) + (other - mean) ** 2 * n * int(k) / both
                mean += (other - mean) * int(k) / both
                n = both
        mean = float(mean)
        self.state.update((n, mean, float(m2)))
        yield pd.DataFrame({"band": [key[0]], "n": [n], "mean": [mean], "sd": [sqrt(m2 / n)]})

    def close(self) -> None:
        pass


def streaming_moments(stream: DataFrame, bands: list[str]) -> DataFrame:
    """Running (band, n, mean, sd) of the bands that a batch has values of; missing values and NaN do not count.

    The state is a row a band, merged from counts, means and squared deviations of the tasks' batches of rows, so that
    large means cost no digits.  For ``each_batch_update``.
    """
    ship(stream.sparkSession)
    values = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])
    long = stream.select(F.inline(values)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    fewer = long.mapInPandas(lambda pdfs: map(_moments, (p for p in pdfs if len(p))), "band string, n long, mean double, m2 double")
    return fewer.groupBy("band").transformWithStateInPandas(_MomentsOfBand(), "band string, n long, mean double, sd double", "Update", "None")
