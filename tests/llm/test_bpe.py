import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import empty, odd_documents
from tokenizers import Tokenizer

from gridloom.llm import bpe
from gridloom.llm.queries import op5_bpe_round_trip

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def own():
    with open(FILE, encoding="utf-8") as f:
        return bpe.ByteBpe(f.read())


def strange_texts(n=1500, seed=4):
    rnd = random.Random(seed)
    letters = [chr(c) for c in [*range(0x250), 0x3000, 0x2003, 0x200B, 0x1F600, 0x5D0, 0x1680, 0x2028, 0x180E, 0xFEFF, 0xA7CE, 0x10940]]
    pool = letters + [" "] * 150 + ["a", "e"] * 50 + ["'s", "'ll", "<|endoftext|>", "\n", "  "] * 12
    fixed = ["", " ", "  ", "a  b", "a \n b", "a\n", "\n\n x  ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "it's we'll I'M 12 34a", "日本語テスト 😀👩‍👩‍👧", "a" * 3000, "ab" * 500, " " * 50 + "x", " \t x"]
    return fixed + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


def test_encodes_as_the_library(own, tokenizer):
    texts = strange_texts()
    words = Counter(w for t in texts for w in own.split(t) if len(w) <= 64)
    lexicon = bpe.Transducer(bpe.mapped(bpe.compile_transducer({w.encode(): own.merge(w.encode()) for w, _ in words.most_common(300)})))
    for encoder in (bpe.Encoder(own, lexicon), bpe.Encoder(own, None)):
        flat, counts = encoder.encode(texts)
        at = 0
        for t, n in zip(texts, counts):
            assert flat[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
            at += n


def test_forgetting_changes_nothing(own, monkeypatch):
    texts = strange_texts(300, 9)
    want = bpe.Encoder(own, None).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "_SLICE", 50)
    assert bpe.Encoder(own, None).encode(texts)[0].tolist() == want


def test_all_merges_agree(own):
    rnd = random.Random(2)
    for _ in range(400):
        w = bytes(rnd.choice(b" etaonishrdlu\xc3\xa9!") for _ in range(rnd.randrange(1, 90)))
        assert own.merge(w) == own.merge_long(w)


def test_transducer_is_exact_and_minimal():
    entries = {w.encode(): (k, k + 1) for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a", ""])}
    t = bpe.Transducer(bpe.mapped(bpe.compile_transducer(entries)))
    assert all(t[w] == ids for w, ids in entries.items())
    assert all(t[w] is None for w in (b"t", b"tapss", b"b", b"stopst", b"st"))
    # States of the minimal automaton: equal right languages are shared.
    rights = {}
    for w in entries:
        for k in range(len(w) + 1):
            rights.setdefault(w[:k], set()).add(w[k:])
    assert t.states == len({frozenset(r) for r in rights.values()})


def test_round_trip_on_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lexicon = bpe.build_lexicon(docs, FILE, size=2000)
    back = bpe.decode_ids(bpe.encode_texts(docs, FILE, lexicon), FILE)
    rows = back.select("text", "ids", "decoded").collect()
    both = bpe.encode_texts(docs, FILE, lexicon, decoded_col="decoded").select("text", "ids", "decoded").collect()
    assert sorted(both) == sorted(rows)
    assert all(r.decoded == r.text for r in rows)
    assert [r.ids for r in rows] == [e.ids for e in tokenizer.encode_batch([r.text for r in rows], add_special_tokens=False)]


def test_word_counts(spark):
    df = spark.createDataFrame([("a bc, a",), ("bc a  a\na",), (None,), ("",)], "text string")
    got = {r.word: r.n for r in bpe.word_counts(df, FILE).collect()}
    assert got[" a"] == 4 and got[" bc"] == 2 and got[","] == 1 and got["a"] == 1


def test_odd_rows(spark):
    odd = odd_documents(spark)
    out = bpe.decode_ids(bpe.encode_texts(odd, FILE, bpe.build_lexicon(odd, FILE)), FILE)
    assert out.count() == odd.count()
    assert out.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert out.where("text is null and size(ids) = 0").count() == 2
    none = bpe.encode_texts(empty(spark), FILE, bpe.build_lexicon(empty(spark), FILE))
    assert none.count() == 0


def test_decoding_replaces_broken_bytes(spark, tokenizer):
    ids = tokenizer.encode("é😀", add_special_tokens=False).ids
    df = spark.createDataFrame([([ids[0]],), (ids,), ([50256],), (None,)], "ids array<int>")
    got = [r.decoded for r in bpe.decode_ids(df, FILE).collect()]
    assert got == [tokenizer.decode(x, skip_special_tokens=False) for x in ([ids[0]], ids, [50256])] + [""]


def test_long_pieces_count(spark):
    """A text without spaces is one piece of any length; its words still reach the lexicon."""
    df = spark.createDataFrame([(1, "日本、" * 300 + "x" * 65)], "doc_id long, text string")
    got = {r.word: r.n for r in bpe.word_counts(df, FILE).collect()}
    assert got["日本"] == 299 and got[" 日本"] == 1 and "x" * 65 not in got


def test_registered_query(spark, tokenizer):
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op5_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
