"""Near-duplicate vectors by spherical-cap filters.

Filters are the directions of random product codes: a vector space cut into blocks of
coordinates, a few random unit vectors for each block, and as directions all their
combinations, after a random rotation.  A vector is decoded to the list of all directions
whose inner product with it comes within ``margin`` of its best one; vectors meet under
equal directions and are verified by cosine in double precision.

Vectors meet twice.  First only names and sketches of 128 signs are dealt out under the
directions, and those without a near sketch there are done.  Then the others are dealt out
with their components under the directions that are left, and compared.

Near vectors share a direction with a probability that several independent rotations bring
close to one: with the defaults 99.9 % of pairs at cosine 0.93 exactly meet, and closer
pairs more surely (see the tests and the README).  The directions are the same for tables of
any size, so that rows which are added never change whether two vectors meet under one.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import connected_components, written

#: Vectors under one direction that a task compares; more are dealt out as pairs of blocks.
BLOCK = 2048
MAX_BROADCAST_KEYS = 500_000
#: Runs of at most so many sketches, or vectors, are compared all at once.
SHORT_SKETCHES, SHORT = 128, 32
#: Bits of a sketch, and standard deviations that its distance may lie above its mean.
SKETCH_BITS, SKETCH_SPREAD = 128, 5.0


@dataclass(frozen=True)
class ProductCodes:
    """``rotations`` codes of ``blocks`` blocks with ``words`` unit vectors each; ``margin``
    is in units of the spread 1/sqrt(dimension) of random inner products."""

    rotations: int = 10
    blocks: int = 2
    words: int = 128
    margin: float = 0.12
    seed: int = 11

    @staticmethod
    def for_rows(n: int) -> ProductCodes:
        """Codes for ``n`` vectors of the largest label: the same for any number, since other
        codes would find other links."""
        return ProductCodes()

    def blocks_of(self, dim: int) -> int:
        """Blocks of at least eight coordinates: in fewer, random words hardly differ and lists
        of directions would grow long."""
        return max(1, min(self.blocks, dim // 8))

    def tables(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Rotations (r, d, d) and code words (r, blocks, words, d / blocks); d is ``dim``
        brought up to a multiple of the blocks."""
        blocks = self.blocks_of(dim)
        d = -(-dim // blocks) * blocks
        rng = np.random.default_rng([self.seed, d])
        turn = np.stack([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(self.rotations)])
        words = min(self.words, 1 << min(d // blocks, 62))  # more in few coordinates would hardly differ
        code = rng.standard_normal((self.rotations, blocks, words, d // blocks))
        return turn, code / np.linalg.norm(code, axis=3, keepdims=True)

    def decode(self, unit: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, direction) of all exceeding directions, by row then direction.

        Block by block only partial combinations whose deficit against the best stays within
        the margin go on, so the work follows the lists and not the number of directions.
        """
        turn, code = tables or self.tables(unit.shape[1])
        n, d = len(unit), turn.shape[1]
        x = np.zeros((n, d))
        x[:, : unit.shape[1]] = unit
        (blocks, words, width), limit = code.shape[1:], self.margin / np.sqrt(d)
        rows, names = [], []
        for r in range(self.rotations):
            y = x @ turn[r]
            row, name, lost = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
            for b in range(blocks):
                s = y[:, b * width : (b + 1) * width] @ code[r, b].T / np.sqrt(blocks)
                short = s.max(axis=1, keepdims=True) - s
                total = lost[:, None] + short[row]
                i, w = np.nonzero(total <= limit)
                row, name, lost = row[i], name[i] * words + w, total[i, w]
            rows.append(row)
            names.append(name + r * words**blocks)
        row, name = np.concatenate(rows), np.concatenate(names)
        order = np.lexsort((name, row))
        return row[order], name[order]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = F.coalesce(F.col(label_col).isNotNull() & v.isNotNull() & finite & some, F.lit(False))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), good.alias("good"))


def _split(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, column.value_lengths().to_numpy(zero_copy_only=False)])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _alike(batch: pa.RecordBatch, column: int):
    """Parts of a batch with vectors of one dimension: (dimension, rows, unit vectors)."""
    vs = _split(batch.column(column))
    dims = np.array([len(v) for v in vs])
    for d in np.unique(dims):
        mine = np.flatnonzero(dims == d)
        for part in np.array_split(mine, -(-len(mine) // 1024)):
            yield int(d), part, _unit(np.stack([vs[i] for i in part]))


def _sketched(kinds: DataFrame, codes: ProductCodes) -> DataFrame:
    """Rows (label, direction, node, s0, s1): each kind of vector, with the signs of its products
    with 128 random vectors, under each of its directions; a direction's number holds the
    dimension."""

    def rows(batches):
        tables = {}
        for batch in batches:
            label, node = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for d, part, unit in _alike(batch, 2):
                if d not in tables:
                    tables[d] = codes.tables(d), np.random.default_rng([codes.seed, d, 1]).standard_normal((d, SKETCH_BITS))
                signs = np.packbits(unit @ tables[d][1] > 0, axis=1).view(np.int64)
                row, name = codes.decode(unit, tables[d][0])
                at = part[row]
                yield pa.RecordBatch.from_arrays([label.take(pa.array(at)), pa.array(name | d << 40), pa.array(node[at]), pa.array(signs[row, 0]), pa.array(signs[row, 1])], ["label", "direction", "node", "s0", "s1"])

    label = dict(kinds.dtypes)["label"]
    return kinds.select("label", "node", "v").mapInArrow(rows, f"label {label}, direction long, node long, s0 long, s1 long")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Adds ``cell``, ``side`` and ``mixed``: for keys of over ``block`` rows, each row goes into
    all pairs of blocks that its own block (side) is in; pairs of two blocks are mixed."""
    keys = ["label", "direction"]
    hot = rows.groupBy(*keys).count().where(F.col("count") > block)
    hot = written(hot.select(*keys, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("n")), "hotkeys")
    many = hot.count()
    if not many:
        return rows.withColumns({"cell": F.lit(0), "side": F.lit(0), "mixed": F.lit(False)})
    joined = rows.join(F.broadcast(hot) if many <= MAX_BROADCAST_KEYS else hot, keys, "left")
    n = F.coalesce("n", F.lit(1))
    joined = joined.withColumns({"n": n, "side": F.pmod(F.xxhash64("node"), n).cast("int")})
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.least(s, F.col("side")) * F.col("n") + F.greatest(s, F.col("side")))
    dealt = joined.withColumn("cell", F.explode(cells))
    return dealt.withColumn("mixed", F.floor(F.col("cell") / F.col("n")) != F.col("cell") % F.col("n")).drop("n")


def _met(sketched: DataFrame, cosine: float, block: int) -> DataFrame:
    """Rows (node, directions): the directions under which a vector has a near sketch."""
    p = acos(max(-1.0, min(1.0, cosine))) / pi
    most = SKETCH_BITS * p + SKETCH_SPREAD * sqrt(SKETCH_BITS * p * (1 - p)) + 1
    keys = ["label", "direction", "cell"]

    def near(batches):
        found = []

        def short(batch, starts, ends):
            """Compares short runs all at once and asks for the long ones."""
            lengths = ends - starts
            may, node, direction = lengths > SHORT_SKETCHES, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 1))
            s = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (4, 5)]
            room = np.repeat(np.where(may, 0, ends), lengths)
            met = np.zeros(batch.num_rows, bool)
            at = np.arange(batch.num_rows)
            for d in range(1, SHORT_SKETCHES):
                at = at[at + d < room[at]]
                if not len(at):
                    break
                hit = at[sum(np.bitwise_count(x[at] ^ x[at + d]).astype(np.int16) for x in s) <= most]
                met[hit] = met[hit + d] = True
            found.append(pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(direction[met])], ["node", "direction"]))
            return may

        for key, part in _runs(batches, 3, short):
            node = part.column(3).to_numpy(zero_copy_only=False)
            s = np.stack([part.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (4, 5)])
            met = np.zeros(len(node), bool)
            for at in range(0, len(node), 256):
                far = sum(np.bitwise_count(x[at : at + 256, None] ^ x).astype(np.int16) for x in s) > most
                np.fill_diagonal(far[:, at:], True)
                met[at : at + 256] = ~far.all(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(np.full(int(met.sum()), key[1]))], ["node", "direction"])
            yield from found
            found.clear()
        yield from found

    rows = _dealt(sketched, block).select(*keys, "node", "s0", "s1").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lambda batches: _gathered(near(batches)), "node long, direction long").groupBy("node").agg(F.collect_set("direction").alias("directions"))


def _listed(kinds: DataFrame, codes: ProductCodes) -> DataFrame:
    """Rows (label, direction, node, weight, v, names): each kind of vector under each of its
    ``directions``; names are all those that it was decoded to."""

    def rows(batches):
        tables = {}
        for batch in batches:
            label, node, weight, v = (batch.column(k) for k in range(4))
            left = _split(batch.column(4))
            for d, part, unit in _alike(batch, 3):
                if d not in tables:
                    tables[d] = codes.tables(d)
                row, name = codes.decode(unit, tables[d])
                name = name | d << 40
                at = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array((name & (1 << 31) - 1).astype(np.int32)))
                own = np.concatenate([left[i] for i in part])
                src = np.repeat(np.arange(len(part)), [len(left[i]) for i in part])
                take = pa.array(part[src])
                yield pa.RecordBatch.from_arrays([label.take(take), pa.array(own), node.take(take), weight.take(take), v.take(take), lists.take(pa.array(src))], ["label", "direction", "node", "weight", "v", "names"])

    kind = dict(kinds.dtypes)
    return kinds.select("label", "node", "weight", "v", "directions").mapInArrow(rows, f"label {kind['label']}, direction long, node long, weight long, v {kind['v']}, names array<int>")


def _compare(ids, weight, side, mixed, unit, names, direction, cut, columns=1024):
    """Links within one cell: weights of partners by vector, counted only under the first
    direction that two vectors share, and a spanning forest of all links."""
    n = len(ids)
    linked = unit @ unit.T >= cut
    np.fill_diagonal(linked, False)
    # Pairs that share a direction before this one meet earlier.
    counted, some = linked.copy(), np.argwhere(np.triu(linked))
    if len(some) <= SHORT:
        for i, j in some:
            if (names[i][names[i] < direction][:, None] == names[j]).any():
                counted[i, j] = counted[j, i] = False
    else:  # columns for these directions: a product above 0 tells such pairs
        flat, owner = np.concatenate(names), np.repeat(np.arange(n), [len(x) for x in names])
        early = flat < direction
        known, column = np.unique(flat[early], return_inverse=True)
        owner = owner[early]
        for c in range(0, len(known), columns):
            these = (column >= c) & (column < c + columns)
            listed = np.zeros((n, columns), np.float32)
            listed[owner[these], column[these] - c] = 1
            for r in range(0, n, columns):
                counted[r : r + columns] &= ~(listed[r : r + columns] @ listed.T > 0)
    if mixed:  # pairs within a block meet in that block's own cell
        counted &= side[:, None] != side
    partners = counted @ weight
    a, b, left = [], [], linked.any(axis=1)
    while left.any():
        stack = [int(np.flatnonzero(left)[0])]
        left[stack[0]] = False
        while stack:
            x = stack.pop()
            hit = np.flatnonzero(linked[x] & left)
            left[hit] = False
            a.append(np.full(len(hit), x))
            b.append(hit)
            stack.extend(hit.tolist())
    none = np.zeros(0, np.int64)
    return partners, ids[np.concatenate([none, *a])], ids[np.concatenate([none, *b])]


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, codes: ProductCodes = ProductCodes(), block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable, its own included) and ``kept``.

    Only vectors of equal, non-null label and equal dimension are compared.  A null or zero
    vector, one with null or non-finite components, and one with a null label links with
    nothing.  Exact copies are compared once and counted as many times as they occur; rows
    that repeat an id count as further vectors.  A null id links as others do but never
    names a component unless all its ids are null.
    """
    rows = _usable(vectors, id_col, vector_col, label_col)
    good = rows.where("good")
    # Two hashes of 64 bits tell kinds of vectors apart; each gets a number, fixed once written.
    kind = {"k0": F.xxhash64("label", "v"), "k1": F.xxhash64(F.lit(1), "label", "v")}
    kinds = good.withColumns(kind).groupBy("k0", "k1").agg(F.count("*").alias("weight"), F.min("id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    kinds = written(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    met = _met(_sketched(kinds, codes), cosine, block)
    cells = _dealt(written(_listed(kinds.join(met, "node"), codes), "listed"), block)

    def links(batches):
        for key, part in _runs(batches, 3, lambda batch, starts, ends: _hold_links(batch, starts, ends, cosine)):
            unit = _unit(part.column(7).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
            if part.num_rows <= 64 and not (np.triu(unit @ unit.T, 1) >= cosine).any():
                continue
            ids, weight, side = (part.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 3))
            partners, a, b = _compare(ids, weight, side, part.column(4)[0].as_py(), unit, _split(part.column(8)), key[1] & (1 << 31) - 1, cosine)
            some = np.flatnonzero(partners)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[some], a]), pa.array(np.r_[partners[some], np.zeros(len(a), np.int64)]), pa.array(np.r_[np.zeros(len(some), np.int64), b]), pa.array(np.r_[np.zeros(len(some), bool), np.ones(len(a), bool)])],
                ["a", "n", "b", "edge"],
            )

    keys = ["label", "direction", "cell"]
    sorted_cells = cells.select(*keys, "side", "mixed", "node", "weight", "v", "names").repartition(*keys).sortWithinPartitions(*keys)
    found = written(sorted_cells.mapInArrow(lambda batches: _gathered(links(batches)), "a long, n long, b long, edge boolean"), "links")
    parts = connected_components(found.where("edge").select("a", "b"))
    counts = found.where("not edge").groupBy("a").agg(F.sum("n").alias("n"))
    known = kinds.drop("v").join(parts, "node", "left").join(counts.select(F.col("a").alias("node"), "n"), "node", "left")
    known = written(known.select("k0", "k1", "weight", "low", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n")), "known")
    roots = written(known.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    told = written(known.join(roots, "root").select("k0", "k1", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"), "told")
    marked = rows.select("id", *[F.when(F.col("good"), h).alias(k) for k, h in kind.items()])
    out = marked.join(told, ["k0", "k1"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _hold_links(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, cut: float, short: int = SHORT) -> np.ndarray:
    """Whether each run may hold a link: short runs are compared all at once, long ones may."""
    lengths = ends - starts
    may = lengths > short
    dims = batch.column(1).to_numpy(zero_copy_only=False) >> 40
    if (dims != dims[0]).any():
        return lengths > 1
    unit = _unit(batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
    run = np.repeat(np.arange(len(starts)), lengths)
    rank, room = np.arange(batch.num_rows) - starts[run], np.where(may, 0, lengths)[run]
    for d in range(1, short):
        at = np.flatnonzero(rank + d < room)
        if not len(at):
            break
        # A hair below the threshold: the exact test follows.
        may[run[at[np.einsum("ij,ij->i", unit[at], unit[at + d]) >= cut - 1e-9]]] = True
    return may


def _runs(batches, width: int, wanted):
    """Runs of two or more rows with equal first ``width`` columns, of batches sorted by
    them, as (key, batch).  What spans batches is put together; of other runs only those
    ``wanted`` come."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], batch.num_rows]
        last = len(starts) - 1
        for k in sorted({0, last, *np.flatnonzero(wanted(batch, starts, ends)).tolist()}):
            key = tuple(c[starts[k]] for c in cols)
            if key != held_key:
                if sum(x.num_rows for x in held) > 1:
                    yield held_key, _joined(held)
                held, held_key = [], key
            held.append(batch.slice(starts[k], ends[k] - starts[k]))
    if sum(x.num_rows for x in held) > 1:
        yield held_key, _joined(held)


def _gathered(batches, rows: int = 8192):
    """Batches of few rows put together to some of ``rows`` or more."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
