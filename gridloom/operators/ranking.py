"""Global order without a global window: row numbers, dictionary codes and exact selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.workspace import scratch_folder

#: Bits of a key that one round of ``smallest`` refines, and so the counts that reach the driver.
ROUND_BITS = 12
_PART, _PLACE = 33, (1 << 33) - 1


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, out: str = "number") -> DataFrame:
    """``df`` with each row's place (long, from 0) in ``order``.

    Rows are partitioned by range and sorted there; the sizes of the partitions, one row each, add
    up to where a partition begins.  Rows that are equal in ``order`` are numbered any way, but
    once: the result is a scratch table and stays as it is.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = _written(dealt, "numbered")
    part = F.shiftright("_at", _PART)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    begin, starts = 0, []
    for s in sizes:
        starts.append((s.part, begin))
        begin += s.n
    # As many rows as there are partitions.
    base = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _base long"))
    joined = placed.withColumn("_of", part).join(base, F.col("_of") == F.col("_part"))
    return joined.withColumn(out, F.col("_base") + F.col("_at").bitwiseAND(_PLACE)).drop("_at", "_of", "_part", "_base")


def within(df: DataFrame, key: str, *order, out: str = "number") -> DataFrame:
    """``df`` with each row's place (long, from 0) among those with the same ``key``, in ``order``.  A
    key of any number of rows is dealt out; one row a key is joined back."""
    placed = _written(numbered(df, key, *order, out="_global"), "placed")
    first = placed.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min("_global").alias("_first"))
    joined = placed.join(first, F.col(f"`{key}`").eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.col("_global") - F.col("_first")).drop("_global", "_key", "_first")


def threshold(df: DataFrame, key: Column, n: int) -> tuple[int | None, int]:
    """(t, m): the ``n`` smallest values of the long ``key`` are those below t and m of those equal to
    it; t is None if there are no more than n rows.

    Counts of ranges of the key are refined, ROUND_BITS bits at a time, about the range in which
    the n-th lies: a few passes of partial aggregation, none of which sorts anything.
    """
    low, bits, left = -(1 << 63), 64, n
    keyed = df.select(key.cast("long").alias("k"))
    while bits:
        step = min(ROUND_BITS, bits)
        bits -= step
        # Keys in order as unsigned numbers: their sign bit is turned.
        turned = F.col("k").bitwiseXOR(F.lit(-(1 << 63)))
        slot = F.shiftrightunsigned(turned, bits).bitwiseAND((1 << step) - 1)
        here = keyed if bits + step == 64 else keyed.where(F.shiftrightunsigned(turned, bits + step) == F.lit((low + (1 << 63)) >> (bits + step)))
        counts = sorted((r.s, r.n) for r in here.groupBy(slot.alias("s")).agg(F.count("*").alias("n")).collect())  # at most 2 ** ROUND_BITS
        if bits + step == 64 and sum(c for _, c in counts) <= n:
            return None, 0
        for s, c in counts:
            if left < c:
                low += s << bits
                break
            left -= c
    return low, left


def smallest(df: DataFrame, key: Column, n: int, *ties) -> DataFrame:
    """The ``n`` rows with the smallest long ``key`` (null first), in no order; of rows equal at the
    threshold those first in ``ties``.  A filter: no row but those at the threshold is sorted or moved."""
    if n <= 0:
        return df.where(F.lit(False))
    key = F.coalesce(key.cast("long"), F.lit(-(1 << 63)))
    t, m = threshold(df, key, n)
    if t is None:
        return df
    below = df.where(key < F.lit(t))
    if not m:
        return below
    at = numbered(df.where(key == F.lit(t)), *ties, out="_tie").where(F.col("_tie") < m).drop("_tie")
    return below.unionByName(at)
