"""SimHash near-duplicates found by the generalised pigeonhole principle.

A document's fingerprint has a bit for every bit position that is set in over
half of the XXH64 values of its word shingles.  Documents whose fingerprints
differ in few bits are linked, and linked documents form groups.

Finding the links exactly, without comparing all pairs:

1.  The 64 bits are grouped into ``m`` partitions so that correlated bits share
    one; correlations come from all distinct fingerprints.
2.  With thresholds T_1..T_m (each -1 or more) that sum to ``radius - m + 1``,
    two fingerprints within ``radius`` agree up to T_i bits on some partition i.
    For each fingerprint a dynamic programme picks the thresholds with the least
    estimated work from histograms over all distinct fingerprints.
3.  Each fingerprint is listed under its own value in every partition and under
    the values within T_i of it; rows with equal keys meet, are compared in
    full, and give a spanning forest of their links rather than all pairs.
4.  Keys with very many rows are dealt out as pairs of blocks, so that
    no task holds an unbounded group; every pair still meets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import connected_components, packed, unpacked, written

#: Histograms look at no more than this many bits of a partition, which bounds them.
HISTOGRAM_BITS = 16
#: The most a single partition's threshold can be.
MAX_T = 2
#: How far sums of thresholds may leave the way to their goal; more than enough for few partitions.
SPARE = 8
#: Rows under one key that one task compares; more are dealt out as pairs of blocks.
BLOCK = 4096
#: Keys above BLOCK that may be broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_KEYS = 500_000
_CHUNK = 1 << 15


# --------------------------------------------------------------- fingerprints
def fingerprint_text(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text as an unsigned integer; 0 where there is no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        h = np.array([digest(joined[s : e - 1], 42) for s, e in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text, shingle: int = 4):
    """The fingerprint of a text column as a signed long; null and empty texts give 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_text(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def fingerprint_hex(fingerprint):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ------------------------------------------------------------------- the plan
@dataclass(frozen=True)
class Partitioning:
    """Bits of each partition, and estimated candidates ``cost[i][t][v]`` by the low ``known``
    bits ``v`` of a value and threshold ``t``.  Bits are numbered through all 64-bit lanes of
    a fingerprint; a partition lies within one lane."""

    bits: tuple[tuple[int, ...], ...]
    cost: tuple[np.ndarray, ...]
    radius: int
    known: int = HISTOGRAM_BITS

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        return [_extract(fps, b) for b in self.bits]


def _extract(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Values of one partition of fingerprints (row x lane; a single lane may be flat)."""
    lane = np.ascontiguousarray(fps.reshape(len(fps), -1)[:, bits[0] // 64])
    out = np.zeros(len(lane), np.uint64)
    for k, b in enumerate(bits):
        out |= ((lane >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def _bit_matrix(lane: np.ndarray) -> np.ndarray:
    return np.unpackbits(lane.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fps(column: pa.Array) -> np.ndarray:
    """Fingerprints (row x lane) from a column of longs, or of arrays of one length."""
    flat = column if pa.types.is_integer(column.type) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def partitions_for(n: int, radius: int) -> int:
    """How many partitions to use for ``n`` distinct fingerprints of one lane.

    The least of probes plus expected candidates for evenly spread values; fewer
    and wider partitions as ``n`` grows.
    """

    def work(m: int) -> float:
        w, spare = 64 // m, radius - m + 1
        per = [spare // m + (i < spare % m) for i in range(m)]
        probes = sum(comb(w, t) for p in per for t in range(p + 1))
        return probes + n * probes / 2.0**w

    return min(range(2, radius + 1), key=work) if radius >= 2 else 2


def correlated_groups(counts: np.ndarray, n: int, m: int, wide: int | None = None) -> tuple[tuple[int, ...], ...]:
    """Greedy groups of bits: each starts at the bit most correlated with those left
    and takes the bits most correlated with the group; evenest bits come first.  A group has
    ``wide`` bits, which can leave some over, or else the ``m`` groups share all 64."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    cor = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(cor, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        width = wide or 64 // m + (k < 64 % m)
        group = [max(left, key=lambda b: cor[b, left].sum())]
        left.remove(group[0])
        while len(group) < width:
            b = max(left, key=lambda x: cor[x, group].sum())
            group.append(b)
            left.remove(b)
        groups.append(tuple(sorted(group, key=lambda b: (abs(p[b] - 0.5), b))))
    return tuple(groups)


def plan_partitions(fps: DataFrame, radius: int, lanes: int = 1, parts: int | None = None, known: int = HISTOGRAM_BITS, width: int | None = None) -> Partitioning:
    """Statistics over all distinct fingerprints in column ``fp``, a long or, for several
    ``lanes``, an array of longs; each lane has ``parts`` partitions, of ``width`` bits if given.

    What reaches the driver is bounded by the method, whatever the input: a 64 x 64 matrix
    for each lane, and 2**known counts for each partition.
    """

    def together(batches):
        total = np.zeros((lanes, 64, 64))
        for batch in batches:
            f = _fps(batch.column(0))
            for at in range(0, len(f), _CHUNK):
                for lane in range(lanes):
                    x = _bit_matrix(np.ascontiguousarray(f[at : at + _CHUNK, lane])).astype(np.float32)
                    total[lane] += x.T @ x
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel().astype(np.int64))], ["at", "c"])

    n = fps.count()
    rows = fps.select("fp").mapInArrow(together, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(lanes * 4096)
    if rows.num_rows:
        counts[rows["at"].to_numpy()] = rows["c"].to_numpy()
    m = parts or partitions_for(n, radius)
    bits = tuple(tuple(64 * lane + b for b in group) for lane, c in enumerate(counts.reshape(lanes, 64, 64)) for group in correlated_groups(c, n, m, width))

    def histograms(batches):
        total = [np.zeros(1 << min(len(b), known), np.int64) for b in bits]
        for batch in batches:
            f = _fps(batch.column(0))
            for k, b in enumerate(bits):
                total[k] += np.bincount(_extract(f, b[:known]).astype(np.int64), minlength=len(total[k]))
        for k, t in enumerate(total):
            v = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.array(t[v])], ["k", "v", "c"])

    rows = fps.select("fp").mapInArrow(histograms, "k long, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c")).toArrow()
    k, v, c = (rows[x].to_numpy() for x in "kvc")
    cost = []
    for i, b in enumerate(bits):
        h = min(len(b), known)
        near = np.zeros((MAX_T + 1, 1 << h), np.float64)  # by exact distance on the histogram's bits
        near[0, v[k == i]] = c[k == i]
        at = np.arange(1 << h)
        for x in range(h):
            near[1] += near[0, at ^ (1 << x)]
            for y in range(x):
                near[2] += near[0, at ^ (1 << x) ^ (1 << y)]
        rest = len(b) - h
        exact = [sum(near[a] * comb(rest, t - a) for a in range(t + 1)) / 2.0**rest for t in range(MAX_T + 1)]
        cost.append(np.cumsum(exact, axis=0).astype(np.float32))
    return Partitioning(bits, tuple(cost), radius, known)


def allocate(plan: Partitioning, values: list[np.ndarray]) -> np.ndarray:
    """Thresholds (fingerprint x partition) of least estimated probes and candidates.

    On the way through the partitions the sum of thresholds stays within SPARE of its range
    between 0 and the goal, which bounds the table of many partitions.
    """
    m, n = len(plan.bits), len(values[0])
    goal = plan.radius - m + 1
    low, high = -min(m, SPARE), goal + min(m, SPARE)
    best = np.full((high - low + 1, n), np.inf, np.float32)
    best[-low] = 0
    picks = []
    for i, b in enumerate(plan.bits):
        v = (values[i] & np.uint64((1 << plan.known) - 1)).astype(np.int64)
        new, pick = np.full_like(best, np.inf), np.full(best.shape, -1, np.int8)
        for t in range(-1, MAX_T + 1):
            price = np.float32(0) if t < 0 else plan.cost[i][t][v] + np.float32(sum(comb(len(b), a) for a in range(t + 1)))
            for s in range(max(0, t), len(best) + min(0, t)):
                total = best[s - t] + price
                better = total < new[s]
                new[s][better], pick[s][better] = total[better], t
        best, picks = new, [*picks, pick]
    out, s = np.zeros((n, m), np.int8), np.full(n, goal - low)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][s, np.arange(n)]
        s = s - out[:, i]
    return out


def _flips(width: int, t: int) -> np.ndarray:
    """Masks of one to t bits."""
    one = [1 << x for x in range(width)] if t >= 1 else []
    two = [(1 << x) | (1 << y) for x in range(width) for y in range(x)] if t >= 2 else []
    return np.array(one + two, np.uint64)


def keyed(fps: DataFrame, plan: Partitioning, carried: list[str]) -> DataFrame:
    """Rows (key, *carried): each fingerprint ``fp`` under its own value in every partition and
    under those that it probes; ``carried`` are columns of longs."""
    shared = fps.sparkSession.sparkContext.broadcast(plan)  # bounded: see plan_partitions
    chunk = max(1024, _CHUNK // len(plan.bits))

    def rows(batches):
        p = shared.value
        flips = [[_flips(len(b), t) for t in range(MAX_T + 1)] for b in p.bits]

        def out(key, who):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(c[who]) for c in columns]], ["key", *carried])

        for batch in batches:
            everything = _fps(batch.column(0))
            whole = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(carried))]
            for at in range(0, len(everything), chunk):
                f = everything[at : at + chunk]
                columns = [c[at : at + chunk] for c in whole]
                values = p.values(f)
                ts = allocate(p, values)
                for i, v in enumerate(values):
                    base = np.uint64(i << 40)
                    yield out(base | v, slice(None))
                    for t in range(1, MAX_T + 1):
                        who = np.flatnonzero(ts[:, i] == t)
                        for part in np.array_split(who, max(1, len(who) * len(flips[i][t]) // 500_000)):
                            if len(part):
                                k = (v[part][:, None] ^ flips[i][t][None, :]) | base
                                yield out(k.ravel(), np.repeat(part, k.shape[1]))

    return fps.select("fp", *carried).mapInArrow(rows, ", ".join(f"{c} long" for c in ["key", *carried]))


def _dealt(rows: DataFrame, carried: list[str], block: int) -> DataFrame:
    """Adds ``cell``: 0 for most keys; for keys with over ``block`` rows, listed and probing,
    the number of a pair of blocks, with a row in every pair of its block."""
    hot = rows.groupBy("key").count().where(F.col("count") > block)
    hot = written(hot.select("key", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("n")), "hotkeys")
    many = hot.count()
    if not many:
        return rows.select("key", F.lit(0).alias("cell"), *carried)
    side = F.broadcast(hot) if many <= MAX_BROADCAST_KEYS else hot
    mine = F.pmod(F.xxhash64(carried[0]), F.col("n")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda s: F.least(s, mine) * F.col("n") + F.greatest(s, mine),
    )
    joined = rows.join(side, "key", "left")
    cold = joined.where("n is null").select("key", F.lit(0).alias("cell"), *carried)
    return cold.union(joined.where("n is not null").select("key", F.explode(cells).alias("cell"), *carried))


# ------------------------------------------------------------------ the links
def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def spanning_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``fps`` (row x lane) of the edges of a spanning forest of its links."""
    a, b, left, stack = [], [], np.arange(len(fps)), []
    while len(left):
        if not stack:
            stack, left = [left[0]], left[1:]
        x = stack.pop()
        hit = _distance(fps[left], fps[x]) <= radius
        found = left[hit]
        if len(found):
            a.append(np.full(len(found), x))
            b.append(found)
            stack.extend(found)
            left = left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_run(cell: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links, as ids, between rows of equal ``cell`` (sorted): all pairs of short runs at once,
    a spanning forest for each long one."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    lengths = np.diff(np.r_[starts, len(cell)])
    a, b = [np.zeros(0, ids.dtype)], [np.zeros(0, ids.dtype)]
    rank = np.arange(len(cell)) - np.repeat(starts, lengths)
    room = np.repeat(np.where(lengths <= small, lengths, 0), lengths)
    for d in range(1, small):
        at = np.flatnonzero(rank + d < room)
        if not len(at):
            break
        at = at[(_distance(fps[at], fps[at + d]) <= radius) & (ids[at] != ids[at + d])]
        a.append(ids[at])
        b.append(ids[at + d])
    for k in np.flatnonzero(lengths > small):
        names, first = np.unique(ids[starts[k] : starts[k] + lengths[k]], return_index=True)
        x, y = spanning_forest(fps[starts[k] + first], radius)
        a.append(names[x])
        b.append(names[y])
    return np.concatenate(a), np.concatenate(b)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each end of the links to the smallest end of its component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, low = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = np.flatnonzero(low != np.arange(len(names)))
    return names[some], names[low[some]]


def candidate_links(fps: DataFrame, plan: Partitioning, carried: list[str], radius: int, block: int = BLOCK, as_stars: bool = False) -> DataFrame:
    """Edges (a, b) whose components are those of all rows of ``fps`` that meet under a key and
    whose carried lanes differ in at most ``radius`` bits.

    The first of ``carried`` names a row; lanes are all that start with ``f``.  Rows under a
    key may hold repeats of one row, by its probes.  With ``as_stars`` edges go to the smallest
    row reached in the same task, which need not be near, and are far fewer in dense groups.
    """
    rows = _dealt(keyed(fps, plan, carried), carried, block)
    own = [2 + k for k, c in enumerate(carried) if c.startswith("f")]

    def links(batches):
        held = None

        def out(*now):
            key, cell, ids = now[:3]
            number = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            a, b = link_run(number, ids, np.stack([now[k].view(np.uint64) for k in own], axis=1), radius)
            if as_stars:
                a, b = stars(a, b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2 + len(carried))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            last = len(same) - int(same.sum())
            held = [x[last:] for x in now]
            if last:
                yield out(*(x[:last] for x in now))
        if held is not None and len(held[0]):
            yield out(*held)

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(links, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links within ``radius`` between
    the distinct fingerprints in column ``fp``.  Exact: no link between groups is lost."""
    return candidate_links(fps.select("fp", F.col("fp").alias("f0")), plan_partitions(fps, radius), ["f0"], radius, block)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long), ``component_id`` (the
    smallest id reachable through links, its own included), ``component_fp``, which tells
    groups apart whatever their ids, and ``text_hash``.

    Null and empty texts have fingerprint 0 and are linked like any other, exact copies
    share a fingerprint, repeated ids give repeated rows, a group whose ids are all null
    has component_id null, and an empty table gives an empty result.  Whole texts count.
    """
    marks = written(
        docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp"), F.xxhash64(F.col(text_col)).alias("text_hash")),
        "fingerprints",
    )
    lowest = written(marks.groupBy("fp").agg(F.min("id").alias("low")), "lowest")
    edges = fingerprint_links(lowest.select("fp"), radius, block)
    parts = connected_components(edges).select(F.col("node").alias("fp"), "root")
    known = written(lowest.join(parts, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "known")
    roots = written(known.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    groups = written(known.join(roots, "root").select("fp", "component_id", F.col("root").alias("component_fp")), "groups")
    return marks.join(groups, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id", "component_fp", "text_hash")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row left for each group: that with the smallest id.

    Of rows that repeat this id within the group one stays; in a group without any id one
    row stays.  Columns and their order are those of ``docs``.
    """
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("text_hash")))
    chosen = simhash_groups(docs, id_col, text_col, **options).groupBy("component_fp").agg(first.alias("first"))
    chosen = written(chosen.select(F.col(f"first.{id_col}").alias("_id"), F.col("first.text_hash").alias("_hash")), "chosen")
    rows = packed(docs, text_col, id=id_col).withColumn("hash", F.xxhash64("text"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    return unpacked(kept.dropDuplicates(["id", "hash"]), docs, text_col)
