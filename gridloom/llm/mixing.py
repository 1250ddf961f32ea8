"""Mixing sources to target weights by Poisson replication.

Each source has a target share.  Its rows are repeated at the mean rate that brings the
source to that share of the wanted total; each row's count inverts the Poisson distribution
at a number in [0, 1) hashed from its id and a seed, so it never depends on partitioning or
on other runs.  Rows are exploded by their counts and shuffled globally.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import packed, unpacked, written

#: Sources whose rates may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000
#: The largest mean whose probabilities are summed up from zero, where exp(-mean) is far from
#: underflow; those of a larger mean are summed up in log space from its lower tail.
MAX_MEAN = 600.0


def hashed_unit(*columns: Column) -> Column:
    """A number in [0, 1) of 52 bits of the MD5 of the columns, joined by colons."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The least k whose cumulative Poisson probability exceeds ``u``, for any mean.

    Sums start at 0, or for means over MAX_MEAN at 10 standard deviations below the mean, and
    stop at 12 above it (at 200 at least): the rest is below the 52 bits of ``u``.
    """
    low = F.when(mean > MAX_MEAN, F.floor(mean - 10 * F.sqrt(mean))).otherwise(0).cast("int")
    high = F.greatest(F.lit(200), F.ceil(mean + 12 * F.sqrt(mean))).cast("int")
    k = low.cast("double")
    # The logarithm of low's probability, its factorial by Stirling's series.
    log_p = k * F.log(mean) - mean - (k * F.log(k) - k + F.log(2 * pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k))
    p = F.when(mean > MAX_MEAN, F.exp(log_p)).otherwise(F.exp(-mean))
    zero = F.struct(p.alias("p"), p.alias("c"), low.alias("k"), F.lit(False).alias("done"))

    def step(acc: Column, i: Column) -> Column:
        done = acc["done"] | (acc["c"] > u)
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), F.when(done, acc["c"]).otherwise(acc["c"] + p).alias("c"), F.when(done, acc["k"]).otherwise(i).alias("k"), done.alias("done"))

    return F.aggregate(F.sequence(low + 1, high), zero, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, default: float = 1.0, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """One row per source: ``source``, its rows ``n`` and ``rate``, its mean repetition.

    ``weights`` are relative, ``default`` holds for sources not named; a weight of 0 drops a
    source by request.  The mix has ``epochs`` times the rows of ``docs`` in expectation.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = written(counts.withColumn("weight", weight), "sources")
    rows, weights_sum = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.col("weight") / F.lit(weights_sum or 1.0) * F.lit(float(epochs) * rows) / F.col("n")
    return weighed.select("source", "n", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, default: float = 1.0, epochs: float = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` repeated to the target weights and shuffled, with ``copy`` (0-based int) and
    ``mix_key`` (hex string, the place in the global order) added; columns of these names are
    replaced.

    Partitions follow from the key and rows are sorted by it inside them, so the layout is a
    random permutation that a lost executor's tasks repeat exactly.  A null source is a
    source of its own; rows with a null id share one count, repeated rows have equal counts
    and keys, null and empty texts are rows like others, an empty table gives none.
    """
    rates = source_rates(docs, weights, default, epochs, source_col)
    small = rates.select(F.col("source").alias("rated"), "rate")
    if rates.count() <= MAX_BROADCAST_SOURCES:
        small = F.broadcast(small)
    rows = packed(docs, text_col, id=id_col, source=source_col).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    rated = rows.join(small, F.col("source").eqNullSafe(F.col("rated")), "left")
    count = poisson_quantile(F.col("rate"), hashed_unit(F.lit(seed), F.col("id")))
    counted = rated.select("row", "text", "id", count.alias("count")).where("count > 0")
    copies = counted.select("row", "text", "id", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), F.col("id"), F.col("copy").cast("string")))
    placed = copies.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    return unpacked(placed, docs, text_col, copy=F.col("copy"), mix_key=F.col("key"))
