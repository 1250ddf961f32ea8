import random
import zlib
from math import log

import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import empty, odd_documents

from gridloom.llm import langid
from gridloom.llm.queries import op6_language_id

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def toy():
    table = {"▁": (0.1, 0.2), "a": (0.1, 0.05), "b": (0.05, 0.1), "ab": (0.2, 0.01), "▁a": (0.1, 0.1), "ba": (0.01, 0.2), "aba": (0.05, 0.05), "▁ab": (0.02, 0.3)}
    return langid.LanguageModel(("x", "y"), table)


def every_segmentation(word, table, lang):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = table[word[:k]][lang] if word[:k] in table else langid.FLOOR if k == 1 else 0.0
        total += p * every_segmentation(word[k:], table, lang)
    return total


def test_forward_sums_all_segmentations():
    m, rnd = toy(), random.Random(1)
    words = ["▁", *("▁" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(200))]
    want = np.array([[log(every_segmentation(w, m.table, k)) for k in (0, 1)] for w in words])
    assert np.allclose(want, [m.word(w, m.longest) for w in words])
    assert np.allclose(want, langid.ForwardPass(m).log_probabilities(words))


@pytest.mark.parametrize("length", [31, 32, 33, 34, 47, 100, 5000])
def test_forward_sums_of_long_words(length):
    m, rnd = toy(), random.Random(length)
    words = ["▁" + "".join(rnd.choice("abc") for _ in range(length + k - 1)) for k in (0, 1, 5)]
    want = []
    for w in words:
        row = []
        for lang in (0, 1):
            ahead = [0.0]  # a plain sum over all last pieces, by logarithms
            for end in range(1, len(w) + 1):
                terms = []
                for start in range(max(0, end - 3), end):
                    p = m.table[w[start:end]][lang] if w[start:end] in m.table else langid.FLOOR if end - start == 1 else 0
                    if p:
                        terms.append(ahead[start] + log(p))
                ahead.append(float(np.logaddexp.reduce(terms)))
            row.append(ahead[-1])
        want.append(row)
    assert np.allclose(want, [m.word(w, m.longest) for w in words], rtol=1e-9)
    assert np.allclose(want, langid.ForwardPass(m).log_probabilities(words), rtol=1e-9)


def test_long_words_are_not_cut(spark):
    """Pieces across the 32nd letter count: without spaces the text is one word."""
    m = langid.LanguageModel(("x", "y"), {"a": (0.3, 0.3), "b": (0.3, 0.3), "ab": (0.01, 0.3), "▁": (0.1, 0.1)})
    df = spark.createDataFrame([(1, "c" * 30 + "ab" + "c" * 5000)], "doc_id long, text string")
    got = langid.predict_language(df, m).first()
    assert got.lang_pred == "y" and abs(got.score - 0.39 / (0.39 + 0.1)) < 1e-9


def test_ties_go_to_the_first_language(spark):
    m = langid.LanguageModel(("m", "n"), {"a": (0.3, 0.3), "▁": (0.1, 0.1)})
    got = langid.predict_language(spark.createDataFrame([(1, "aa a")], "doc_id long, text string"), m).first()
    assert (got.lang_pred, got.score) == ("m", 0.5)


def test_expected_counts_of_long_words():
    p = {"a": 0.1, "b": 0.05, "ab": 0.2, "▁": 0.1}
    for n in (30, 31, 32, 33, 3000):
        got: dict = {}
        word = "▁" + "abb" * n
        langid.expected_counts(word, 1.0, p, 2, got)
        assert abs(sum(len(k) * c for k, c in got.items()) - len(word)) < 1e-8 * len(word)
        assert abs(got["ab"] / n - 0.9756) < 0.001


def test_expected_counts_by_enumeration():
    p = {k: v[0] for k, v in toy().table.items()}

    def walk(word):
        if not word:
            return [(1.0, [])]
        return [(p.get(word[:k], langid.FLOOR if k == 1 else 0.0) * q, [word[:k], *rest]) for k in range(1, len(word) + 1) if word[:k] in p or k == 1 for q, rest in walk(word[k:])]

    paths = walk("▁abab")
    whole, want = sum(q for q, _ in paths), {}
    for q, pieces in paths:
        for x in pieces:
            want[x] = want.get(x, 0) + 3 * q / whole
    got = {}
    langid.expected_counts("▁abab", 3, p, 3, got)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return langid.train_language_model(docs, langid.vocabulary_pieces(PIECES), max_docs=20, rounds=2)


def test_odd_rows(spark, model):
    odd = odd_documents(spark)
    out = langid.predict_language(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "score"]
    got = {(r.doc_id, r.text is None): (r.lang_pred, r.score) for r in out.collect()}
    assert got[3, True] == got[None, True] == got[4, False] == got[7, False] == got[8, False] == ("und", 0.0)
    assert got[5, False][0] == "en" and got[6, False][0] != "und"
    assert langid.predict_language(empty(spark), model).count() == 0


def test_no_labels(spark):
    m = langid.train_language_model(empty(spark), ["a"])
    assert m.languages == ()
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert langid.predict_language(df, m).first().lang_pred == "und"
