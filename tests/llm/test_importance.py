import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, documents, empty, odd_documents

from gridloom.llm import importance
from gridloom.llm.queries import op12_importance_resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=10_000):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [crc32(r.encode("utf-8")) % buckets for r in runs]


def plain(docs, target):
    """Rows (doc_id, n_features, weight, score, rank)."""
    found = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10000.0) / ((s[b] + 1.0) * (total_t + 10000.0)))) for b in range(10_000)]
    rows = []
    for k, n_words, f in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((k, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return {r[0]: (*r[1:4], rank.get(r[0])) for r in rows}


def run(spark, df, target):
    return importance.resampled(df, target).select("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("block", [1, 3, 8, 64])
def test_checksums_of_spans(block):
    rnd = random.Random(block)
    data = rnd.randbytes(5000)
    spans = [(a, min(5000, a + rnd.choice([1, 2, 7, 8, 9, 63, 64, 65, 128, 129, 700, 4000]))) for a in (rnd.randrange(5000) for _ in range(300))]
    starts, ends = (np.array(x) for x in zip(*spans))
    got = importance.span_checksums(np.frombuffer(data, np.uint8), starts, ends, block)
    assert got.tolist() == [crc32(data[a:b]) for a, b in spans]
    n = np.array([1, 5, 64, 1000, 123_456])
    assert importance.length_constants(n).tolist() == [crc32(bytes(k)) for k in n.tolist()]


def test_features():
    texts = ["One, two THREE four", "", "ÄÖ é 1a_b", "x" * 3000 + " y " + "Z" * 200, "!?", "İK"]
    data = [t.encode() for t in texts]
    got = [[] for _ in texts]
    for found, text in importance.feature_buckets(data):
        for b, k in zip(found.tolist(), text.tolist()):
            got[k].append(b)
    assert got == [features(t)[1] for t in texts]


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["Über", "x" * 300, "NAÏVE"]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for k in range(300)]
    target = ["w1 w2 w3 w4 Über", "w5 w1 w2", ""]
    df = documents(spark, docs).withColumns({c: F.lit(1) for c in ("at", "late", "part", "base", "score", "rank", "id")})
    side = spark.createDataFrame([(t,) for t in target] + [(None,)], "text string")
    got = {r[0]: tuple(r[1:]) for r in run(spark, df, side).collect()}
    assert got == plain(docs, target)
    assert sum(r[3] is not None for r in got.values()) == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100 > 0


def test_odd_rows(spark):
    df, side = odd_documents(spark), spark.createDataFrame([("word of it",)], "text string")
    out = run(spark, df, side).collect()
    assert len(out) == df.count()
    assert {r.n_features for r in out if r.doc_id == 3} == {0} and {r.weight for r in out if r.doc_id in (3, 4)} == {0}
    want = plain([(r.doc_id, r.text) for r in df.collect()], ["word of it"])
    assert {r.doc_id: r.weight for r in out if r.doc_id is not None} == {k: v[1] for k, v in want.items() if k is not None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert run(spark, empty(spark), none).collect() == []
    df = spark.createDataFrame([(1, "a b c", None, None, 5)], SCHEMA)
    assert [tuple(r) for r in run(spark, df, none).collect()] == [(1, *plain([(1, "a b c")], [])[1])]


def test_on_documents(spark):
    d = "/root/testdata/sf0.001"
    docs, side = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in side.collect()])
    assert {r[0]: tuple(r[1:]) for r in op12_importance_resampling(spark, d).collect()} == want
