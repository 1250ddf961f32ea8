import numpy as np
import public_tokenizers
from tests.llm.helpers import odd_documents
from tests.llm.test_linededup import brute as dedup
from tests.llm.test_mixing import brute as mix
from tests.llm.test_neardup import brute as near
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import langid
from gridloom.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train_language_model(docs, langid.vocabulary_pieces(corpus_pipeline.PIECES_FILE))
    longest, rows = model.longest, []
    for r in docs.collect():
        scores = np.array([model.word(w, longest) for u in (r.text or "").split() for w in langid.words_of(u)]).reshape(-1, len(model.languages)).sum(axis=0)
        sure = 1 / np.exp(scores - scores.max()).sum() if langid._LETTERS.search(r.text or "") else 0
        if sure >= corpus_pipeline.MIN_SCORE:
            rows.append((r.doc_id, r.text, r.source))
    left = {k: v for (k, _), v in dedup([(k, t) for k, t, _ in rows]).items()}
    part, _ = near([(k, left[k]) for k, _, _ in rows])
    kept = [(k, s) for k, _, s in rows if part[k] == k]
    copies = mix(kept, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_SEED)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((k, s, tokenizer.encode(left[k], add_special_tokens=False).ids) for (k, s), n in copies.items() for _ in range(n))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.source, list(r.ids)) for r in out) == want
    assert all(r.exact and r.n_tokens == len(r.ids) for r in out)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.where("n_chars != length(text)").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_on_odd_rows(spark):
    """Each stage alone, and one after the other, on nulls, empty and long texts, repeated rows
    and clashing columns."""
    odd = odd_documents(spark)
    alone = {name: stage(spark, odd, SF).collect() for name, stage in corpus_pipeline.STAGES}
    ids = {name: sorted(str(r.doc_id) for r in rows) for name, rows in alone.items()}
    assert set(ids["language"]) <= {"1", "2", "5", "6", "None"} and ids["language"].count("2") == 2
    assert ids["line_dedup"] == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert ids["near_dedup"].count("2") <= 1 and not {"4", "7"} & set(ids["near_dedup"]) and ids["near_dedup"].count("3") == 1
    assert ids["mixing"].count("2") % 2 == 0
    assert len(alone["encoding"]) == odd.count() and all(r.exact for r in alone["encoding"])
    assert all(r.n_tokens == 0 for r in alone["encoding"] if r.doc_id in (3, 4))
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "odd")
    assert {r.doc_id for r in docs.collect()} <= {1, 2, 5, 6, None}
