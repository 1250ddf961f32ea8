"""A corpus pipeline: documents in, token ids out, each stage one operator of ``gridloom.llm``.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``, with ``n_chars`` brought up to date where the text changed; other columns are
left out.

No stage fails on nulls in any column, empty or very long texts, ties, repeated rows or an empty
table.  Null and empty texts, and others without letters, have no language and go with the first
stage; what a later stage does with them when run alone, and with repeated rows, its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, linededup, mixing, neardup
from gridloom.llm.shared import spread, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents without letters, or whose language is less sure than this, are rejected.
MIN_SCORE = 0.5
MIX_WEIGHTS = {"src0": 4.0}
MIX_SEED = 42
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; models are trained on the labelled ones.
    Repeated rows all stay or all go, a tie of languages has a score of 0.5 and stays, a null
    ``lang`` only teaches nothing; without any label no language is known and nothing stays."""
    docs = spread(docs.select(*COLUMNS))
    model = langid.train_language_model(docs, langid.vocabulary_pieces(PIECES_FILE))
    told = langid.predict_language(docs, model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; every document stays, some with less text.  Null texts stay
    null; rows with equal id and text count as one document and keep equal texts."""
    left = linededup.dedup_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates, the one with the smallest id: those
    linked by a Jaccard similarity of five-word shingles of 0.8 or more.  Candidates come from
    SimHash fingerprints by the generalised pigeonhole search.  Texts without words, null ones
    included, are one group, and of repeated rows one stays."""
    return neardup.keep_one_of_near(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources, in a global random order.  A
    null source is a source of its own; repeated rows have equal counts."""
    return mixing.mix_sources(docs.select(*COLUMNS), MIX_WEIGHTS, seed=MIX_SEED).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again to show that nothing was lost.  A null or empty
    text has no tokens and is exact; repeated rows have equal ids."""
    coded = bpe.encode_texts(docs.select(*COLUMNS), BPE_FILE, bpe.build_lexicon(docs, BPE_FILE), decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("exact"))


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot express the trained and hashed stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
