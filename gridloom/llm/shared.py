"""Helpers shared by the operators: scratch tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship
from gridloom.sources.workspace import scratch_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a new folder below ``spark.checkpoint.dir``."""
    return scratch_folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back, which cuts its lineage.

    The files lie in the shared folder, so losing executors loses nothing.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out evenly where it has fewer partitions than there are cores, as
    a small table in one file has; large tables stay as they are, without a shuffle."""
    ship(table.sparkSession)
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def packed(docs: DataFrame, text_col: str, **named: str) -> DataFrame:
    """``text``, the ``named`` columns under their new names, and ``row``, a struct of all
    columns but the text: an operator's own names then cannot clash with any column's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, docs: DataFrame, text_col: str, **added: Column) -> DataFrame:
    """The columns of ``docs`` in order, from ``row`` and ``text``, and the added ones, which
    take the place of columns of the same name."""
    kept = [c for c in docs.columns if c not in added]
    return df.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept], *[v.alias(n) for n, v in added.items()])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given by long columns ``a`` and ``b``.

    Returns ``node`` and ``root`` (the smallest node reachable) for every node
    that can reach a smaller one; roots themselves have no row.  Self loops,
    repeated edges and edges with a null end are ignored.  An empty input gives
    an empty result.

    Alternates large-star and small-star steps, each a partially aggregated
    minimum and one join, until the edges no longer change.  A node with very
    many edges is met only by partial aggregates and by joins whose two inputs
    are scratch tables, which adaptive execution splits when skewed.
    """
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = written(e, "edges")
    before = _fingerprint(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = written(small, "edges")
        after = _fingerprint(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fingerprint(e: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
