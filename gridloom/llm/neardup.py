"""SimHash near-duplicates by similarity: documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.

Fingerprints of 64 bits within a few bits of each other, as ``simhash`` links them, are too
strict for this: a pair at 0.8 differs in 10 bits on average.  So the search goes wider:

1.  Each set gets a SimHash of some lanes of 64 bits.  The generalised pigeonhole search of
    ``simhash`` runs over all of them: correlated bits of a lane share one of its partitions,
    and thresholds are allocated by dynamic programming on candidate counts.  Sets that differ
    in fewer bits than there are partitions meet for certain; of pairs at 0.8 exactly, which
    differ in about 15 % of the bits, over 99 % do (see the README).  The width of a partition
    grows with the logarithm of the number of documents, so that a key has about KEY_ROWS sets
    at any scale, and the number of partitions by as much as keeps the chance to meet
    (``search_for``): work grows as the 1.23rd power of the number of documents.
2.  Sets that meet and are near on their first two lanes are candidates; their components are
    candidate groups, from spanning forests and without lists of pairs.
3.  The texts of a group meet in one task, where a spanning forest of the pairs whose exact
    similarity is high enough is found; other pairs are not linked.  Large groups are dealt
    out as pairs of blocks, so that no task holds an unbounded group; every pair still meets.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.shared import connected_components, packed, unpacked, written
from gridloom.llm.simhash import candidate_links, plan_partitions

#: Sets that share a key by chance, about; bits of the narrowest and of the widest key; partitions
#: that find over 99 % of pairs at 0.8 with the narrowest; and the share of bits in which such
#: pairs agree, so that a key of one bit more needs 1 / AGREE times as many partitions.
KEY_ROWS, NARROWEST, WIDEST, PARTITIONS, AGREE = 256, 16, 40, 80, 0.85
#: Bits of a partition's value that histograms look at, which bounds them.
KNOWN_BITS = 12
#: Of the 128 bits of the first two lanes, those that candidates may differ in: at a similarity
#: of 0.8 they differ in 19 on average, this many are four standard deviations more.
NEAR = 36
#: Sets, and shingles, of one block of a candidate group.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
# Fixed values of the SplitMix64 generator, which makes a shingle's lanes out of its hash.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Search(NamedTuple):
    """Lanes of a fingerprint, and partitions of a lane, each of ``width`` bits."""

    lanes: int
    parts: int
    width: int


def search_for(n: int) -> Search:
    """The search among ``n`` documents: keys wide enough for about KEY_ROWS sets each, and so
    many partitions that pairs at 0.8 meet as surely at every ``n``."""
    width = min(max(NARROWEST, ceil(log2(max(n, 1) / KEY_ROWS))), WIDEST)
    parts = 64 // width
    return Search(ceil(PARTITIONS * AGREE ** (NARROWEST - width) / parts), parts, width)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle."""
    words = " ".join(text.lower().split()).encode("utf-8", "surrogatepass").split(b" ") if text else []
    if not words or not words[0]:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        return np.array([digest(joined)], np.uint64)
    return np.unique(np.array([digest(joined[s : e - 1]) for s, e in zip([0, *ends], ends[shingle - 1 :])], np.uint64))


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """As many unsigned numbers: a bit is 1 if it is set in over half the hashes' lanes."""
    offsets = np.arange(1, lanes + 1).astype(np.uint64) * _STEP
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        z = hashes[at : at + 255, None] + offsets
        z ^= z >> np.uint64(30)
        z *= _MIX[0]
        z ^= z >> np.uint64(27)
        z *= _MIX[1]
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places in ``sets`` of a spanning forest of all pairs of similarity ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    # Shingles by number, so that a set is looked up in many others by one gather.
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mine = ends - sizes, np.zeros(len(names), bool)
    left, edges, stack = np.arange(len(sets)), [], []
    while len(left):
        if not stack:
            stack, left = [left[0]], left[1:]
        x = stack.pop()
        fit = np.minimum(sizes[left], sizes[x]) >= least * np.maximum(sizes[left], sizes[x])
        found = np.zeros(len(left), bool)
        if fit.any():
            near, own = left[fit], flat[starts[x] : ends[x]]
            mine[own] = True
            if 4 * len(near) <= len(sets):
                both = np.array([np.count_nonzero(mine[flat[starts[y] : ends[y]]]) for y in near])
            else:
                both = np.add.reduceat(mine[flat], starts, dtype=np.int64)[near]
            mine[own] = False
            found[fit] = both >= least * (sizes[x] + sizes[near] - both)
        edges += [(x, y) for y in left[found]]
        stack += list(left[found])
        left = left[~found]
    return edges


def _marked(docs: DataFrame, shingle: int, count: int) -> DataFrame:
    """Rows (id, text_hash, digest, size, fp): a digest of the set, its shingles, its ``count`` lanes."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                sets = [shingle_set(t.as_py(), shingle) for t in some.column(2)]
                lanes = np.stack([wide_fingerprint(h, count) for h in sets]).astype(np.uint64).view(np.int64)
                fp = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * count), pa.array(lanes.ravel()))
                digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), digests, pa.array([len(h) for h in sets], pa.int64()), fp], ["id", "text_hash", "digest", "size", "fp"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, digest binary, size long, fp array<long>"
    return docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, schema)


def _candidates(sets: DataFrame, search: Search, block: int) -> DataFrame:
    """Rows (node, root): candidate groups of two sets or more."""
    wide = sets.where("size > 0").select("fp", "node", F.col("fp")[0].alias("f0"), F.col("fp")[1].alias("f1"))
    plan = plan_partitions(wide, search.lanes * search.parts - 1, search.lanes, search.parts, KNOWN_BITS, search.width)
    # Stars: a is smallest.  Each set joins its smallest star, which joins the set's others; a
    # set has a star for a key at most.
    met = candidate_links(wide, plan, ["node", "f0", "f1"], NEAR, block, as_stars=True)
    low = met.withColumn("low", F.min("a").over(W.partitionBy("b")))
    edges = low.select(F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b")).distinct()
    parts = written(connected_components(edges), "candidates")
    return parts.select("node", "root").union(parts.select("root", "root").distinct())


def similar_links(docs: DataFrame, sets: DataFrame, search: Search, least: float, shingle: int, block: int) -> DataFrame:
    """Edges (a, b) between sets, whose components are those of all verified candidates."""
    member = written(sets.join(_candidates(sets, search, 8 * block), "node").select("node", "root", "size", F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash")), "members")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    member = member.join(written(member.groupBy("root").agg(blocks.alias("n")), "blocks"), "root")
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.least(s, mine) * F.col("n") + F.greatest(s, mine))
    texts = docs.select("id", "text").withColumn("hash", F.xxhash64("text"))
    found = texts.join(written(member.select("_id", "_hash", "node", "root", cells.alias("cells")), "cells"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    dealt = found.select("root", F.explode("cells").alias("cell"), "node", "text")

    def links(batches):
        at, held = None, {}

        def out():
            names, edges = list(held), similar_forest(list(held.values()), least)
            return pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for root, cell, name, text in zip(*(batch.column(k) for k in range(4))):
                here = (root.as_py(), cell.as_py())
                if here != at:
                    if len(held) > 1:
                        yield out()
                    at, held = here, {}
                if name.as_py() not in held:
                    held[name.as_py()] = shingle_set(text.as_py(), shingle)
        if len(held) > 1:
            yield out()

    return dealt.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(links, "a long, b long")


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5, block: int = BLOCK, search: Search | None = None) -> DataFrame:
    """The rows of ``docs`` with one row left for each group of near duplicates: that with the
    smallest id.

    Groups are the components of the pairs with Jaccard similarity ``least`` or more.  Texts
    without words are one group.  Of rows that repeat the smallest id one stays; in a group
    without any id one row stays.  ``search`` is planned for the number of rows unless given.  Columns and their order are those of ``docs``.
    """
    rows = packed(docs, text_col, id=id_col)
    search = search or search_for(rows.count())
    marks = written(_marked(rows, shingle, search.lanes), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    sets = marks.groupBy("digest").agg(first.alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "distinct")  # fixed once written
    parts = connected_components(similar_links(rows, sets, search, least, shingle, block)).select("node", "root")
    chosen = sets.select("node", "first").join(parts, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    chosen = written(chosen.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash")), "chosen")
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    kept = hashed.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    return unpacked(kept.dropDuplicates(["id", "hash"]), docs, text_col)
