"""Importance resampling towards a target distribution.

Features are runs of one to three consecutive words.  A feature's bucket is its CRC-32 modulo
the number of buckets, and a bucket's gain is the logarithm of its share among the target's
features over that among the corpus'.  Documents are drawn by their summed gains plus a Gumbel
noise made of their ids, which is sampling without replacement by importance.

Checksums come from position tables.  CRC-32 is affine over bits: the checksum of a string is
the exclusive or of one contribution a byte, which depends on the byte and on its distance from
the end, and of a constant that depends on the length.  A table holds the contributions for
distances below BLOCK; ``numpy.bitwise_xor.reduceat`` sums them up over the spans of features.
Longer spans are cut into blocks from their end, which are folded two and two by tables that
move a checksum on by BLOCK, 2 BLOCK, 4 BLOCK, ... bytes of zero.
"""

from __future__ import annotations

from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import written

BUCKETS, RUN = 10_000, 3
#: Distances from the end that the table knows.
BLOCK = 64
#: Bytes of text whose features are looked at together, and bytes of features at a time.
BATCH_BYTES, SPAN_BYTES = 1 << 20, 1 << 21
_LOW = np.array([32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


# ------------------------------------------------------------------- checksums
def _moved(values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Checksums moved on by the zero bytes of four tables, one for each of their bytes."""
    return tables[0][values & 255] ^ tables[1][values >> 8 & 255] ^ tables[2][values >> 16 & 255] ^ tables[3][values >> 24]


@cache
def position_table(block: int = BLOCK) -> np.ndarray:
    """Row d: what each byte contributes at distance d from the end."""
    first = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)
    rows = [first]
    for _ in range(block - 1):  # one zero byte more after it
        rows.append(first[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.stack(rows)


@cache
def _zeros(power: int, block: int | None = None) -> np.ndarray:
    """Tables that move a checksum on by 2 ** power bytes, or blocks, of zero."""
    if power:
        half = _zeros(power - 1, block)
        return np.stack([_moved(_moved(half_row, half), half) for half_row in _identity()])
    one = position_table(1)[0]
    out = _identity()
    for _ in range(block or 1):
        out = one[out & 255] ^ (out >> 8)
    return out


def _identity() -> np.ndarray:
    return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """Checksums of as many zero bytes."""
    out, left, power = np.full(len(lengths), 0xFFFFFFFF, np.uint32), lengths.astype(np.int64), 0
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _moved(out[odd], _zeros(power))
        left, power = left >> 1, power + 1
    return out ^ np.uint32(0xFFFFFFFF)


def span_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """CRC-32 of each non-empty span [start, end) of the bytes ``data``."""
    lengths = ends - starts
    blocks = -(-lengths // block)
    out = np.zeros(len(starts), np.uint32)
    long = np.flatnonzero(blocks > 1)
    short = np.flatnonzero(blocks == 1)
    out[short] = _linear(data, starts[short], ends[short], block)
    if len(long):
        # Blocks of a span numbered from its end; only the first of a span may be shorter.
        n = blocks[long]
        span = np.repeat(np.arange(len(long)), n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        stops = ends[long][span] - number * block
        sums = _linear(data, np.maximum(stops - block, starts[long][span]), stops, block)
        power = 0
        while len(sums) > len(long):
            odd = (number & 1).astype(bool)
            sums[odd] = _moved(sums[odd], _zeros(power, block))
            heads = np.flatnonzero(~odd)
            sums = np.bitwise_xor.reduceat(sums, heads)
            span, number, power = span[heads], number[heads] >> 1, power + 1
        out[long] = sums
    known = length_constants(np.arange(1, 4 * block))
    near = lengths < 4 * block
    out[near] ^= known[lengths[near] - 1]
    out[~near] ^= length_constants(lengths[~near])
    return out


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Contributions of the bytes of spans of at most ``block`` bytes, SPAN_BYTES at a time."""
    table, lengths = position_table(block).ravel(), ends - starts
    out, sums = np.zeros(len(starts), np.uint32), np.cumsum(lengths)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SPAN_BYTES, "right")))
        some = lengths[at:to]
        heads = np.cumsum(some) - some
        # A byte's distance from the end, and its place: both fall and rise by one within a span.
        inner = np.arange(some.sum())
        place = inner + np.repeat(starts[at:to] - heads, some)
        distance = np.repeat(heads + some - 1, some) - inner
        out[at:to] = np.bitwise_xor.reduceat(table[(distance << 8) + data[place]], heads)
        at = to
    return out


# -------------------------------------------------------------------- features
def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words of all texts, lower-cased and each followed by one space; starts and
    ends of the words in them; and the text of each word."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    raw = raw + _LOW[raw]
    is_word = _WORD[raw]
    last = np.zeros(len(raw), bool)  # what follows a word
    last[1:] = is_word[:-1] & ~is_word[1:]
    kept = is_word | last
    data = np.where(last, np.uint8(32), raw)[kept]
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(bounds, np.flatnonzero(last), "left")


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS, run: int = RUN, block: int = BLOCK):
    """For runs of each length up to ``run``: their buckets, and the text of each."""
    data, starts, ends, text = word_spans(texts)
    for k in range(run):
        n = len(starts) - k
        if n <= 0:
            return
        same = np.flatnonzero(text[:n] == text[k:])
        if len(same):
            yield span_checksums(data, starts[same], ends[same + k], block) % np.uint32(buckets), text[same]


def _slices(column: pa.Array):
    """Texts (null: empty) in lists of about BATCH_BYTES, each with the place of its first."""
    held, size, at = [], 0, 0
    for k, t in enumerate(column):
        held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) of all features of all texts; tasks add up before anything is shuffled."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                for found, _ in feature_buckets(texts, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = docs.select(F.col(f"`{text_col}`")).mapInArrow(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) by bucket, from
    counts s and t of both, which add up to S and T.  As many numbers as buckets."""
    spark = corpus.sparkSession
    s, t = (written(counts, "buckets").select("bucket", F.col("n").alias(name)) for counts, name in ((corpus, "s"), (target, "t")))
    total = s.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0], t.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    up = (F.col("t") + 1).cast("double") * F.lit(float(total[0] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total[1] + buckets))
    rows = every.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")).collect()  # one row a bucket
    return [g for _, g in sorted((r.bucket, r.gain) for r in rows)]


def importance_weights(docs: DataFrame, gains: list[int], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and ``n_words``, ``n_features`` and ``weight`` (long), the sum
    of the gains of its features; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_features", "weight")]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`"))
    gain = np.array(gains, np.int64)

    def weighted(batches):
        for batch in batches:
            n, words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            for at, texts in _slices(batch.column(len(kept))):
                to = at + len(texts)
                for k, (found, text) in enumerate(feature_buckets(texts, len(gain))):
                    here = np.bincount(text, minlength=len(texts))
                    if k == 0:
                        words[at:to] = here
                    features[at:to] += here
                    np.add.at(n, text + at, gain[found])
            weight[:] = n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, (words, features, weight))], [*kept, "n_words", "n_features", "weight"])

    added = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return slim.mapInArrow(weighted, T.StructType([*slim.schema.fields[:-1], *added]))


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), seed: int = 42, least_words: int = 20, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and n_words, n_features, weight, score and rank (long).

    Of the N documents of ``least_words`` words or more, the floor(share * N) with the highest
    scores are drawn and ranked from 1; ties go to the smaller id, and among repeated ids any
    way.  The others' rank is null.  A score is the weight plus floor(1000 g), g a Gumbel variate
    from the SHA-256 of seed and id (a null id: empty).  Null and empty texts have no features,
    weight 0, and an empty target leaves all gains to the corpus alone.

    Ranks come from one range partitioning by score, whose partitions' sizes are added up, so
    that no task sorts all rows.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets), buckets)
    names = [c for c in docs.columns if c not in (text_col, "n_words", "n_features", "weight", "score", "rank")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0)]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = importance_weights(packed, gains).withColumn("score", F.col("weight") + noise).withColumn("late", F.col("n_words") < least_words)
    scored = written(scored, "scored")  # range partitioning reads its input twice
    order = ["late", F.desc("score"), F.asc_nulls_last("id")]
    placed = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(~F.col("late")).alias("fit")).collect())  # one row a partition
    drawn, before, bases = sum(s.fit for s in sizes) * share[0] // share[1], 0, []
    for s in sizes:
        bases.append((s.part, before))
        before += s.n
    base = F.broadcast(docs.sparkSession.createDataFrame(bases, "part long, base long"))
    ranked = placed.withColumn("part", part).join(base, "part").withColumn("rank", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    return ranked.select(*[F.col("row").getField(c).alias(c) for c in names], "n_words", "n_features", "weight", "score", F.when((F.col("rank") <= drawn) & ~F.col("late"), F.col("rank")).alias("rank"))
