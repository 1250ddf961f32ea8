import numpy as np
import pytest
import xxhash
from tests.llm.helpers import components, documents, empty, odd_documents

from gridloom.llm import simhash


def slow_fingerprint(text, shingle=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint(spark):
    texts = ["", " \t\n", "One", "one two Three", "A b c d e f É\x0bg\x1ch", "the the the the the the", "x " * 70_000, None]
    for t in texts:
        assert simhash.fingerprint_text(t) == slow_fingerprint(t)
    # The hash is that of the engine itself.
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1) == xxhash.xxh64("a b c d", seed=42).intdigest()


def scattered(seed, n, copies, bits):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    out = [base]
    for _ in range(copies):
        x = base.copy()
        for _ in range(bits):
            x ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


def brute(fps, radius=4):
    pairs = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= radius]]
    signed = [int(x) for x in fps.view(np.int64)]
    at = dict(zip((int(x) for x in fps), signed))
    return components(signed, [(at[a], at[b]) for a, b in pairs])


@pytest.mark.parametrize("block,parts", [(4096, None), (16, None), (4096, 2), (4096, 3), (4096, 4)])
def test_links_lose_nothing(spark, monkeypatch, block, parts):
    rng = np.random.default_rng(1)
    ball = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 400), dtype=np.uint64), axis=0)
    fps = np.unique(np.r_[scattered(7, 400, 2, 5), ball])
    if parts:
        monkeypatch.setattr(simhash, "partitions_for", lambda n, radius: parts)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = [(r.a, r.b) for r in simhash.fingerprint_links(df, block=block).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in pairs)
    assert components([int(x) for x in fps.view(np.int64)], pairs) == brute(fps)


def test_thresholds_follow_the_principle(spark):
    fps = scattered(3, 500, 1, 3)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    plan = simhash.plan_partitions(df, 4)
    assert sorted(b for part in plan.bits for b in part) == list(range(64))
    t = simhash.allocate(plan, plan.values(fps))
    assert (t.sum(axis=1) == 4 - len(plan.bits) + 1).all() and t.min() >= -1


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.simhash_groups(docs).collect()
    fps = np.array([slow_fingerprint(t) for t in (r.text for r in docs.where("doc_id < 60").orderBy("doc_id").collect())], np.uint64)
    got = {r.doc_id: r for r in rows}
    assert [got[k].fingerprint & (2**64 - 1) for k in range(60)] == [int(f) for f in fps]
    every = np.array([r.fingerprint for r in rows], np.int64).view(np.uint64)
    ids = [r.doc_id for r in rows]
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 4)]
    want = components(ids, pairs)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert sorted(r.doc_id for r in simhash.keep_one_per_group(docs).collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    odd = odd_documents(spark)
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.fingerprint == 0]
    assert {r.doc_id for r in zero} == {3, 4, 7, None} and {r.component_id for r in zero} == {3}
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    got = [r.doc_id for r in kept.collect()]
    assert got.count(2) == 1 and got.count(3) == 1 and 4 not in got and got.count(None) == 1
    assert simhash.simhash_groups(empty(spark)).count() == 0
    assert simhash.keep_one_per_group(empty(spark)).count() == 0


def test_copies_leave_one(spark):
    docs = documents(spark, [(k, "the same long text of many words in every copy") for k in range(5, 60)] + [(1, "quite another text that has other words in it")])
    assert sorted(r.doc_id for r in simhash.keep_one_per_group(docs).collect()) == [1, 5]
