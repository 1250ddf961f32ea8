"""Prefix trie of conversations, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of the first d turns; it is named by the smallest conversation
that begins with it, and d.  Prefixes are told apart by 128 bits: exclusive ors of hashes of the
turns with their places, which run on along a conversation in blocks of turns.

Sums over subtrees would take a pass for each level of depth, and a long conversation has many.
Instead the forest of parent edges is split at centroids: of each component the deepest node
with over half the weight below it.  Taking it out leaves parts of at most half the weight: the
parts below it, whose total is aggregated once and added along the path from the centroid to
the component's top, and the rest.  A node weighs as many turns as its members still have from
there on, itself included, which one aggregate tells for all nodes at once; paths only ever
lessen it.  Rounds are as many as halvings: components of up to LOCAL weight are finished by
the tasks, each by the same splitting in arrays.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.shared import written

#: Weight, and so at most the nodes, of a component that a task finishes.
LOCAL = 20_000
#: Turns of a conversation whose hashes run on in one window.
BLOCK = 4096
#: Ids of conversations that are joined into one row of text.
IDS = 4096
#: Characters of a role or text by which turns are dealt out; they are sorted by all.
HEAD = 64


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, pos, len, g1, g2, chars): each turn's place from 1 in its conversation, the
    conversation's length, two hashes of role and text, and the code points of the text.

    Turns are ordered by ``turn_col``, null first, then role and text; a null role or text is
    empty, repeated rows are turns of their own.  Rows without a conversation belong to none and
    are left out.  One range partitioning numbers all turns, so that a conversation of any
    length is dealt out over tasks.
    """
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]).where("conv is not null")
    dealt = rows.repartitionByRange("conv", "turn", F.substring("role", 1, HEAD), F.substring("text", 1, HEAD)).sortWithinPartitions("conv", "turn", "role", "text")
    hashes = [F.xxhash64("role", "text").alias("g1"), F.xxhash64(F.lit("second"), "text", "role").alias("g2")]
    placed = written(dealt.select("conv", *hashes, F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33)  # the rest counts rows of a partition
    runs = placed.groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = W.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), (F.col("first") - before).alias("zero"), F.sum("n").over(w).alias("len"))
    joined = placed.join(written(runs, "runs"), (F.col("conv") == F.col("_c")) & (part == F.col("_p")))
    return joined.select("conv", (F.col("at") - F.col("zero") + 1).alias("pos"), "len", "g1", "g2", "chars")


def rebranched(turns: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``shared`` (at most ``most``) turns of conversation
    ``base`` in place of as many of their own; both are columns over ``conv``.  A base that is
    absent has no turns, a shorter one gives all it has.  Returns the turns, and rows (conv, len)
    of all conversations, those left without a turn included."""
    sizes = written(turns.groupBy("conv").agg(F.max("len").alias("len")), "sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    plan = sizes.select("conv", "len", base.alias("base"), shared.cast("long").alias("shared")).join(bases, "base", "left")
    head = F.least("shared", F.coalesce("base_len", F.lit(0)))
    plan = written(plan.select("conv", "base", "shared", head.alias("head"), (head + F.greatest(F.col("len") - F.col("shared"), F.lit(0))).alias("len")), "plan")
    named = plan.select(F.col("conv").alias("to"), "base", "shared", "head", F.col("len").alias("new_len"))
    slim = turns.drop("len")
    own = slim.join(named, F.col("conv") == F.col("to")).where("pos > shared").withColumn("pos", F.col("pos") - F.col("shared") + F.col("head"))
    lent = slim.where(F.col("pos") <= most).join(named, F.col("conv") == F.col("base")).where("pos <= shared")
    cut = [F.col("to").alias("conv"), "pos", F.col("new_len").alias("len"), "g1", "g2", "chars"]
    return own.select(*cut).unionByName(lent.select(*cut)), plan.select("conv", "len")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv, depth, len, k1, k2, p1, p2, chars): keys of the prefix that ends with the
    turn, and of the one before it."""
    tags = [F.xxhash64(F.lit(k), "pos", "g1", "g2").alias(f"t{k}") for k in (1, 2)]
    tagged = turns.select("conv", "pos", "len", "chars", *tags, F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    # Long conversations, beyond one block, run on over their blocks' totals.
    totals = tagged.where(F.col("len") > BLOCK).groupBy("conv", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), *[F.bit_xor(f"x{k}").over(earlier).alias(f"c{k}") for k in (1, 2)])
    within = W.partitionBy("conv", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    run = tagged.select("*", *[F.bit_xor(f"t{k}").over(within).alias(f"r{k}") for k in (1, 2)])
    joined = run.join(carried, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    keys = joined.select("*", *[F.col(f"r{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))).alias(f"k{k}") for k in (1, 2)])
    return keys.select("conv", F.col("pos").alias("depth"), "len", "k1", "k2", *[F.col(f"k{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)], "chars")


def prefix_trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row for each node of the trie of conversations, as ``rebranched`` returns them: conv_id
    (the smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree, itself included),
    saved_tokens (over its subtree, (n_convs - 1) times the code points of a node's last text)
    and ends_sha256 (of the ids of members that end here).

    Equal conversations are members of the same nodes; one without turns is a member of the root
    alone.  Without conversations there is no node.
    """
    rows = written(_prefixes(turns), "prefixes")
    members = [F.min("conv").alias("m"), F.count("*").alias("n_convs")]
    nodes = rows.groupBy("depth", "k1", "k2").agg(*members, F.sum(F.col("len") - F.col("depth") + 1).alias("w"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("chars").alias("chars"))
    nodes = written(nodes, "keyed")
    root = convs.agg(*members, F.sum(F.col("len") + 1).alias("w")).first()
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("pm"))
    nodes = written(nodes.join(above, ["depth", "p1", "p2"], "left").withColumn("pm", F.coalesce("pm", F.lit(root.m).cast("long"))), "nodes")
    paths = written(rows.select("conv", "depth", "len", "k1", "k2").join(nodes.select("depth", "k1", "k2", "m", "pm"), ["depth", "k1", "k2"]).select("conv", "depth", "len", "m", "pm"), "paths")
    top = convs.sparkSession.createDataFrame([(root.m, 0, None, root.n_convs, root.w, 0)] if root.n_convs else [], "m long, depth long, pm long, n_convs long, w long, chars long")
    every = nodes.select(*top.columns).union(top)
    kids = every.where("depth > 0").groupBy(F.col("pm").alias("m"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    every = written(every.join(kids, ["m", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    values = every.select("m", "depth", "pm", "w", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"))
    sums = subtree_sums(values, paths, local)
    last = paths.where("depth = len").select("conv", "m", "depth").union(convs.where("len = 0").select("conv", F.lit(root.m).cast("long"), F.lit(0).cast("long")))
    told = every.join(sums, ["m", "depth"]).join(_ends(last), ["m", "depth"], "left")
    return told.select(F.col("m").alias("conv_id"), "depth", F.col("pm").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


# ------------------------------------------------------- sums over subtrees
def subtree_sums(nodes: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """Rows (m, depth, leaves, tokens): sums of both over each node's subtree.

    ``nodes``: (m, depth, pm, w, leaves, tokens), a tree with its root at depth 0, w the weight
    below.  ``paths``: (conv, depth, m, pm), the node and its parent of each conversation at
    each depth, so that a node's ancestors are those of its conversation m.
    """
    root = nodes.where("depth = 0").select("m", "w").first()
    if root is None:
        return nodes.select("m", "depth", "leaves", "tokens")
    whole = [F.lit(root.m).alias("cm"), F.lit(0).cast("long").alias("cd"), F.lit(root.w).alias("total")]
    # As a table: joins on columns that the optimiser knows to be constant would be cross joins.
    sized, parts, finished = written(nodes.select("m", "depth", "pm", "w", "leaves", "tokens", *whole), "sized"), [], []
    while True:
        finished.append(sized.where(F.col("total") <= local).drop("total"))
        large = sized.where(F.col("total") > local)
        at = F.struct("depth", "m", "w")
        cut = large.where("2 * w > total").groupBy("cm", "cd").agg(F.max(at).alias("z"))
        cut = written(cut.select("cm", "cd", F.col("z.m").alias("zm"), F.col("z.depth").alias("zd"), F.col("z.w").alias("zw")), "centroids")
        if cut.isEmpty():
            break
        moved = written(_split(large, cut, paths), "split")
        sums = moved.where("below or z").groupBy("cm", "cd").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
        parts.append(moved.where("path or z").select("m", "depth", "cm", "cd").join(written(sums, "sums"), ["cm", "cd"]).select("m", "depth", "leaves", "tokens"))
        under = F.col("below")
        state = moved.where("not z").select("m", "depth", "pm", (F.col("w") - F.when(F.col("path"), F.col("zw")).otherwise(0)).alias("w"), "leaves", "tokens", F.when(under, F.col("child")).otherwise(F.col("cm")).alias("cm"), F.when(under, F.col("zd") + 1).otherwise(F.col("cd")).alias("cd"))
        total = written(state.groupBy("cm", "cd").agg(F.max("w").alias("total")), "totals")
        sized = written(state.join(total, ["cm", "cd"]), "sized")
    parts.append(_finished(reduce(DataFrame.unionByName, finished)))
    return reduce(DataFrame.union, parts).groupBy("m", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))


def _split(large: DataFrame, cut: DataFrame, paths: DataFrame) -> DataFrame:
    """``large`` with its component's centroid, and where a node lies: the centroid itself, below
    it in the part of ``child``, or on the path above it."""
    # Members that go on below a centroid, each with the node they go to.
    onward = cut.select("cm", "cd", F.col("zm").alias("pm"), (F.col("zd") + 1).alias("depth")).join(paths.select("pm", "depth", F.col("conv").alias("m"), F.col("m").alias("child")), ["pm", "depth"])
    # Nodes of the centroids' own conversations, among which are all those above them.
    line = paths.select(F.col("conv").alias("zm"), "depth", "m").join(cut.select("zm").distinct(), "zm", "left_semi").withColumn("line", F.lit(True))
    known = large.join(cut, ["cm", "cd"]).join(onward.select("cm", "cd", "m", "child"), ["cm", "cd", "m"], "left").join(line, ["zm", "depth", "m"], "left")
    z = (F.col("m") == F.col("zm")) & (F.col("depth") == F.col("zd"))
    below = (F.col("depth") > F.col("zd")) & F.col("child").isNotNull()
    path = (F.col("depth") < F.col("zd")) & ((F.col("depth") == 0) | F.col("line").isNotNull())
    return known.select("m", "depth", "pm", "w", "leaves", "tokens", "cm", "cd", "zd", "zw", "child", z.alias("z"), below.alias("below"), path.alias("path"))


def centroid_sums(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row a node) over subtrees of a forest, given by each node's parent
    (-1: none) and its positive weight with all that is below it.  All components are split at
    their centroids at once, until no node is left."""
    here, up, w = np.arange(len(parent)), parent.copy(), weight.copy()
    out, alive = np.zeros_like(values), np.ones(len(parent), bool)
    top = _tops(up)
    while alive.any():
        heavy = here[alive & (2 * w > w[top])]  # a path from each top down
        inner = np.zeros(len(up), bool)
        inner[up[heavy][up[heavy] >= 0]] = True
        z = heavy[~inner[heavy]]
        alive[z] = False
        gone = np.zeros(len(up), bool)
        gone[z] = True
        above = up[z]
        up[(up >= 0) & gone[up]] = -1
        tops = _tops(up)
        below = alive & (tops != top)
        total = np.zeros_like(values)
        np.add.at(total, top[below], values[below])
        found, less = total[top[z]] + values[z], w[z]
        out[z] += found
        while len(above):
            on = above >= 0
            above, found, less = above[on], found[on], less[on]
            out[above] += found
            w[above] -= less
            above = up[above]
        top = tops
    return out


def _tops(up: np.ndarray) -> np.ndarray:
    top = np.where(up < 0, np.arange(len(up)), up)
    while True:
        further = top[top]
        if (further == top).all():
            return top
        top = further


def _finished(parts: DataFrame) -> DataFrame:
    """Sums within components of bounded weight; a task takes whole components together."""

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            size += batch.num_rows
            if size > LOCAL:
                block = np.concatenate(held)
                key = block[:, 6:]
                ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
                if len(ends):
                    yield _summed(block[: ends[-1]])
                    block = block[ends[-1] :]
                held, size = [block], len(block)
        if size:
            yield _summed(np.concatenate(held))

    slim = parts.select("m", "depth", F.coalesce("pm", "m").alias("pm"), "w", "leaves", "tokens", "cm", "cd")
    return slim.repartition("cm", "cd").sortWithinPartitions("cm", "cd", "depth").mapInArrow(rows, "m long, depth long, leaves long, tokens long")


def _summed(block: np.ndarray) -> pa.RecordBatch:
    m, depth, pm, w, cm, cd = (block[:, k] for k in (0, 1, 2, 3, 6, 7))
    # A node's parent is found among the nodes by its name, unless the node is its component's top.
    place = {name: k for k, name in enumerate(zip(m.tolist(), depth.tolist()))}
    inside = ((m != cm) | (depth != cd)).tolist()
    parent = np.array([place[p, d - 1] if i else -1 for p, d, i in zip(pm.tolist(), depth.tolist(), inside)], np.int64)
    sums = centroid_sums(parent, w, block[:, 4:6])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (m, depth, sums[:, 0], sums[:, 1])], ["m", "depth", "leaves", "tokens"])


# -------------------------------------------------- digests of those that end
def _ends(last: DataFrame) -> DataFrame:
    """Rows (m, depth, sha) from (conv, m, depth).  Ids are sorted over all tasks and joined to
    texts of up to IDS ids; only such texts of one node meet, and pass its digest one by one."""

    def joined(batches):
        at, held = None, []

        def out():
            return pa.RecordBatch.from_pylist([{"m": at[0], "depth": at[1], "first": held[0], "ids": ",".join(map(str, held))}])

        for batch in batches:
            for conv, m, depth in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (m, depth) != at or len(held) == IDS:
                    if held:
                        yield out()
                    at, held = (m, depth), []
                held.append(conv)
        if held:
            yield out()

    def digested(batches):
        at, sha = None, None
        for batch in batches:
            done = []
            for m, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (m, depth) != at:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (m, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["m", "depth", "sha"])
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(("m", "depth", "sha"), (*at, sha.hexdigest())))])

    texts = last.repartitionByRange("m", "depth", "conv").sortWithinPartitions("m", "depth", "conv").mapInArrow(joined, "m long, depth long, first long, ids string")
    return texts.repartition("m", "depth").sortWithinPartitions("m", "depth", "first").select("m", "depth", "ids").mapInArrow(digested, "m long, depth long, sha string")
