import hashlib
from math import exp, lgamma, log

import pytest
from tests.llm.helpers import empty, odd_documents

from gridloom.llm import mixing


def unit(seed, doc_id):
    return int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def quantile(mean, u):
    p = c = exp(-mean)
    k = 0
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def brute(rows, weights, seed, epochs=1.0):
    """(id, source) -> copies."""
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    whole = sum(weights.get(s, 1.0) for s in n)
    out = {}
    for k, s in rows:
        rate = weights.get(s, 1.0) / whole * epochs * len(rows) / n[s]
        out[k, s] = quantile(rate, unit(seed, k))
    return out


def counted(df):
    got = {}
    for r in df.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    return got


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source) for r in docs.collect()]
    for weights, epochs in (({"src0": 4.0}, 1.0), ({"src1": 0.0, "src2": 900.0}, 2.5)):
        want = {k: n for k, n in brute(rows, weights, 7, epochs).items() if n}
        assert counted(mixing.mix_sources(docs, weights, epochs=epochs, seed=7)) == want


def test_shares_meet_their_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'t' as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    got = counted(mixing.mix_sources(docs, {"hot": 7.0}))
    total, hot = sum(got.values()), sum(n for (_, s), n in got.items() if s == "hot")
    assert abs(total - 6000) < 5 * 6000**0.5 and abs(hot / total - 0.5) < 0.03


def test_layout_does_not_follow_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keys = [[(r.mix_key, r.doc_id, r.copy) for r in mixing.mix_sources(d).collect()] for d in (docs, docs.repartition(5))]
    assert sorted(keys[0]) == sorted(keys[1]) and len({k for k, _, _ in keys[0]}) == len(keys[0])
    assert keys[0] != sorted(keys[0], key=lambda k: k[1])


def test_shuffle_join_of_many_sources(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = counted(mixing.mix_sources(docs))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert counted(mixing.mix_sources(docs)) == want


def test_odd_rows(spark):
    odd = odd_documents(spark)
    out = mixing.mix_sources(odd, {"a": 2.0, None: 3.0}, epochs=3.0)
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy", "mix_key"]
    got = {}
    for r in out.collect():
        got[r.doc_id, r.source, r.text] = got.get((r.doc_id, r.source, r.text), 0) + 1
    assert all(n % 2 == 0 for (k, _, _), n in got.items() if k == 2)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(odd, default=0.0).count() == 0


@pytest.mark.parametrize("mean", [30.0, 49.5, 100.0, 600.0, 601.0, 1000.0])
def test_large_rates_are_one_poisson(spark, mean):
    n = 1000
    docs = spark.range(n).selectExpr("id as doc_id", "'t' as text", "'s' as source")
    got = counted(mixing.mix_sources(docs, epochs=mean, seed=3))

    def inverted(u):
        c, k = exp(-mean), 0
        while c <= u:
            k += 1
            c += exp(k * log(mean) - mean - lgamma(k + 1))
        return k

    counts = [got.get((k, "s"), 0) for k in range(n)]
    assert counts == [inverted(unit(3, k)) for k in range(n)]
    average = sum(counts) / n
    assert abs(average - mean) < 5 * (mean / n) ** 0.5
    assert 0.8 * mean < sum((c - average) ** 2 for c in counts) / n < 1.2 * mean
