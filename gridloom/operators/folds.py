"""Folds and splits: keyed by row id, so that no result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.pixels import keyed_order


def with_fold(df: DataFrame, k: int, id_col: str, seed: int = 666, arithmetic: bool = False) -> DataFrame:
    """Independent, even folds 1..k (not balanced to equal sizes)."""
    if k < 1:
        raise ValueError("at least one fold")
    return df.withColumn("fold", (F.pmod(keyed_order(id_col, seed, arithmetic), F.lit(k)) + 1).cast("int"))


def fold_counts(df: DataFrame, k: int) -> DataFrame:
    """Rows of each fold 1..k, 0 included."""
    every = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("fold"))
    counts = df.groupBy("fold").agg(F.count("*").alias("n"))
    return every.join(counts, "fold", "left").select("fold", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def split(df: DataFrame, test_fold: int, k: int) -> DataFrame:
    """Rows with ``split`` test or train; with a single fold each row goes to both."""
    if not 1 <= test_fold <= k:
        raise ValueError(f"test fold {test_fold} of {k}")
    if k == 1:
        return df.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    return df.withColumn("split", F.when(F.col("fold") == test_fold, "test").otherwise("train"))
