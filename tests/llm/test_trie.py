import hashlib
import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import trie
from gridloom.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows, base, shared):
    """{conv: [(role, text)]} of rows (conv, turn, role, text)."""
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            convs.setdefault(c, []).append((r or "", x or ""))
    return {c: convs.get(base(c), [])[: shared(c)] + own[shared(c) :] for c, own in convs.items()}


def plain(convs):
    """Rows of the trie by going through every prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        ends = sorted(c for c in own if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        leaves = sum(not any(q[:-1] == p for q in under if len(q) == len(p) + 1) for p in under)
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids), leaves, saved, sha))
    return sorted(out, key=str)


def built(spark, rows, local=trie.LOCAL):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "pos", "len", "at", "m", "depth")})
    conv = F.col("conv")
    turns = trie.numbered_turns(df)
    convs = trie.rebranched(turns, conv - conv % 10, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    return sorted(map(tuple, trie.prefix_trie(*convs, local=local).collect()), key=str)


def expected(rows):
    return plain(rebuilt(rows, lambda c: c - c % 10, lambda c: crc32(str(c).encode()) % 6))


def conversations(n, seed):
    rnd = random.Random(seed)
    said = ["", None, "yes", "no", "später\n", "x" * 30]
    rows = [(c, rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice(["user", "assistant", None]), rnd.choice(said)) for c in range(n) for _ in range(rnd.randrange(1, 9))]
    return rows + [(None, 1, "user", "nobody's"), rows[0], rows[0]]


def test_equals_brute_force(spark):
    rows = conversations(60, 1)
    want = expected(rows)
    assert built(spark, rows) == want
    assert built(spark, rows, local=12) == want  # many rounds of splitting


def test_long_conversation_in_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 3, 14) for t in range(40 + 3 * c)] + conversations(20, 2)
    assert built(spark, rows, local=25) == expected(rows)


def test_equal_conversations_and_digests_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 5)
    rows = [(c, t, "user", "same") for c in range(100, 130) for t in range(4)]
    assert built(spark, rows) == expected(rows)


def test_empty_and_one(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, None, None, None)]) == []
    assert built(spark, [(7, None, None, None)]) == expected([(7, None, None, None)])


def test_centroid_sums():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 400):
        parent = np.array([-1, *(int(rnd.integers(max(0, k - 3), k)) if rnd.random() < 0.7 else int(rnd.integers(-1, k)) for k in range(1, n))], np.int64)
        own, values = rnd.integers(1, 9, n), rnd.integers(0, 100, (n, 2))
        weight, sums = own.copy(), values.copy()
        for k in range(n - 1, 0, -1):
            if parent[k] >= 0:
                weight[parent[k]] += weight[k]
                sums[parent[k]] += sums[k]
        assert (trie.centroid_sums(parent, weight, values) == sums).all()


def test_on_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = plain(rebuilt([tuple(r) for r in rows], lambda c: c - c % 100, lambda c: crc32(str(c).encode()) % 6))
    assert sorted(map(tuple, op13_conversation_trie(spark, "/root/testdata/sf0.001").collect()), key=str) == want
