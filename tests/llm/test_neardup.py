import random

import numpy as np
import pytest
from tests.llm.helpers import components, documents, empty, odd_documents

import corpus_pipeline
from gridloom.llm import neardup


def brute(docs, least=0.8):
    """[(id, text)] -> smallest id of each group, comparing all pairs."""
    sets = {}
    for k, t in docs:
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return components(ids, pairs), pairs


def recall(search, least, most, pairs):
    """The share of pairs at a similarity of 0.8 exactly, or a little above, of sets of so many
    shingles, that agree in a whole partition and are near on their first lanes."""
    rng = np.random.default_rng(4)
    met = 0
    places = [64 * lane + search.width * k for lane in range(search.lanes) for k in range(search.parts)]
    for _ in range(pairs):
        each = int(rng.integers(max(1, least // 9), most // 9 + 1))  # in one set only
        both = rng.integers(0, 2**63, 8 * each).astype(np.uint64)
        one, two = (np.r_[both, rng.integers(0, 2**63, each).astype(np.uint64)] for _ in range(2))
        a, b = neardup.wide_fingerprint(one, search.lanes), neardup.wide_fingerprint(two, search.lanes)
        near = np.bitwise_count(a[:2] ^ b[:2]).sum() <= neardup.NEAR
        differ = np.cumsum(np.r_[0, np.unpackbits((a ^ b).view(np.uint8), bitorder="little")])
        met += bool(near and any(differ[p] == differ[p + search.width] for p in places))
    return met / pairs


@pytest.mark.parametrize("n,pairs", [(0, 1000), (10**8, 300), (4 * 10**10, 150)])
def test_recall_of_candidates(n, pairs):
    """At any number of documents at least 99 % of pairs just at the similarity are compared exactly."""
    assert recall(neardup.search_for(n), 9, 400, pairs) >= 0.99


def test_recall_of_short_sets():
    """Sets of four and five shingles with four in common."""
    rng, search, met = np.random.default_rng(6), neardup.search_for(0), 0
    for _ in range(500):
        two = rng.integers(0, 2**63, 5).astype(np.uint64)
        a, b = neardup.wide_fingerprint(two[:4], search.lanes), neardup.wide_fingerprint(two, search.lanes)
        met += bool(np.bitwise_count(a[:2] ^ b[:2]).sum() <= neardup.NEAR and (a.view(np.uint16) == b.view(np.uint16)).any())
    assert met >= 0.93 * 500


def test_keys_grow_with_the_documents():
    assert neardup.search_for(0) == neardup.search_for(14 * 10**6) == (20, 4, 16)
    for n in (10**6, 10**9, 4 * 10**10, 10**12):
        search = neardup.search_for(n)
        assert n / 2**search.width <= neardup.KEY_ROWS and search.parts * search.width <= 64
        # Keys a document grow as the power of n that keeps the chance to meet.
        assert search.lanes * search.parts <= 2 * 80 * max(1, n / (neardup.KEY_ROWS << 16)) ** 0.235


def test_wide_fingerprint_is_a_majority():
    rng = np.random.default_rng(5)
    for n, wide in ((0, 20), (1, 20), (2, 7), (255, 20), (256, 33), (1000, 20)):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        got = neardup.wide_fingerprint(h, wide)
        lanes = []
        for x in h.tolist():
            row = []
            for k in range(1, wide + 1):
                z = (x + k * 0x9E3779B97F4A7C15) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                row.append(z ^ z >> 31)
            lanes.append(row)
        for k in range(wide):
            assert int(got[k]) == sum(1 << b for b in range(64) if sum(r[k] >> b & 1 for r in lanes) * 2 > n)


def edited(rnd, base, words):
    out = list(base)
    for _ in range(words):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block,n", [(512, 0), (7, 0), (512, 10**9)])
def test_stage_equals_brute_force(spark, block, n):
    rnd = random.Random(1)
    docs = []
    for _ in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 300))]
        docs += [" ".join(base), *(edited(rnd, base, rnd.randrange(1, len(base) // 20)) for _ in range(3))]
    hot = [f"h{k}" for k in range(200)]
    docs += [edited(rnd, hot, rnd.randrange(6)) for _ in range(60)]
    docs = list(enumerate(docs))
    want, pairs = brute(docs)
    assert len(pairs) > 300 and len(set(want.values())) > 60
    kept = neardup.keep_one_of_near(documents(spark, docs), block=block, search=neardup.search_for(n)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    if block == neardup.BLOCK and not n:
        stage = corpus_pipeline.near_dedup_stage(spark, documents(spark, docs), "")
        assert sorted(r.doc_id for r in stage.collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    odd = odd_documents(spark)
    kept = neardup.keep_one_of_near(odd)
    assert kept.columns == odd.columns
    got = [r.doc_id for r in kept.collect()]
    # Of ten shingles of 2, eight are in 1.
    assert 1 in got and 2 not in got and got.count(3) == 1 and 4 not in got and 7 not in got and got.count(None) == 1
    assert [r.doc_id for r in neardup.keep_one_of_near(odd.where('doc_id = 2')).collect()] == [2]
    assert neardup.keep_one_of_near(empty(spark)).count() == 0
