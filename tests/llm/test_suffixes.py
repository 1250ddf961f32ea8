import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, empty, odd_documents

from gridloom.llm import suffixes
from gridloom.llm.queries import op11_suffix_dedup


def plain(texts, length):
    """[(spans, kept)] by counting every string of the length."""
    data = [(t or "").encode() for t in texts]
    met = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if met[d[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        out.append(([tuple(e) for e in edges.tolist()], bytes(b for b, g in zip(d, gone[1:]) if not g)))
    return out


def made(seed, n, passages=6, most=120):
    """Texts of letters with passages, edits in them, overlaps and copies."""
    rnd = random.Random(seed)
    noise = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    common = [noise(rnd.randrange(20, most)) for _ in range(passages)] + ["-" * 90, "abab" * 20, "één ✓ " * 9]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.choice(common)
            a = rnd.randrange(len(p))
            p = p[a:] if rnd.random() < 0.4 else p[: a + 1] if rnd.random() < 0.4 else p
            if rnd.random() < 0.3:
                p = p[: len(p) // 2] + "X" + p[len(p) // 2 :]
            parts += [p, noise(rnd.randrange(0, 60))]
        texts.append("".join(parts))
    return texts + texts[:3]


def run(df, length, **more):
    rows = suffixes.remove_repeats(df, length=length, **more).select("doc_id", "spans", "kept").collect()
    return {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in rows}


@pytest.mark.parametrize("length", [20, 36, 50])
def test_windows_of_a_class_from_merged_shards(length):
    rnd = random.Random(length)
    core = "the same words stand here in all of them, more or less"
    texts = []
    for _ in range(40):
        x = rnd.randrange(length)
        texts.append(("".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9))) + core[: rnd.randrange(30, len(core))] + "q" * x).ljust(length, "z").encode())
    groups, counts = np.sort(np.array([rnd.randrange(5) for _ in texts])), np.array([rnd.choice([1, 1, 1, 2]) for _ in texts])
    met = Counter()
    for g, t, n in zip(groups, texts, counts):
        for i in range(len(t) - length + 1):
            met[g, t[i : i + length]] += n
    want = [[i for i in range(len(t) - length + 1) if met[g, t[i : i + length]] > 1] for g, t in zip(groups, texts)]
    for shards in (1, 2, 5):
        assert [s.tolist() for s in suffixes.repeated_windows(groups, texts, counts, length, shards)] == want


def test_merged_order_is_the_sorted_order():
    rnd = np.random.default_rng(1)
    texts = [rnd.integers(1, 4, rnd.integers(1, 12)).tolist() + [0] for _ in range(9)]
    transforms, sorted_shards = [], []
    for some in (texts[:4], texts[4:7], texts[7:]):
        at = [(k, i) for k, t in enumerate(some) for i in range(len(t))]
        place = {p: n for n, p in enumerate(at)}
        symbols = np.array([some[k][i] for k, i in at])
        ahead = np.array([place.get((k, i + 1), -1) for k, i in at])
        behind = np.array([place[k, i - 1] if i else place[k, len(some[k]) - 1] for k, i in at])
        order, before = suffixes.shard_transform(symbols, ahead, behind)
        sorted_shards.append([some[at[o][0]][at[o][1] :] for o in order])
        assert sorted_shards[-1] == sorted(sorted_shards[-1])
        transforms.append(before)
    source, interval = suffixes.merged_intervals(transforms, np.array([True, False, False, False]), 12)
    nexts = [iter(s) for s in sorted_shards]
    merged = [next(nexts[s]) for s in source]
    assert merged == sorted(s for shard in sorted_shards for s in shard)
    assert [a == b for a, b in zip(merged, merged[1:])] == (interval[1:] == interval[:-1]).tolist()


@pytest.mark.parametrize("group", [2048, 3])
def test_equals_brute_force(spark, group):
    texts = made(7, 120)
    df = documents(spark, list(enumerate(texts))).withColumns({c: F.lit(1) for c in ("d1", "c", "spans", "bytes", "a.b", "wanted")})
    assert run(df, 24, group=group) == dict(enumerate(plain(texts, 24)))  # classes of over 3 contexts are cut finer


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 500)
    texts = [t * 3 for t in made(8, 12, most=300)]
    assert run(documents(spark, list(enumerate(texts))), 30, group=4) == dict(enumerate(plain(texts, 30)))


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = suffixes.remove_repeats(df)
    assert out.count() == df.count()
    got, want = run(df, 400), plain([r.text for r in df.collect() if r.text is None or len(r.text) < 1000], 400)
    assert {k: got[k] for k in (1, 3, 4, 7)} == {1: want[0], 3: ([], b""), 4: ([], b""), 7: ([], b"   \n\t \n  \n")}
    assert got[5] == ([(0, 300_000)], b"") and got[6] == ([(0, 200_000)], b"")


def test_empty_table(spark):
    assert suffixes.remove_repeats(empty(spark)).collect() == []


def test_on_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = {r.doc_id: (sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for r, (spans, kept) in zip(rows, plain([r.text for r in rows], 400))}
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in op11_suffix_dedup(spark, d).collect()} == want
