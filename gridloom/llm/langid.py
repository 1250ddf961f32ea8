"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has probabilities for the pieces of one fixed public vocabulary.  The
probability of a word is the sum over all ways to cut it into pieces, by a forward
algorithm; training maximises the same sum by expectation-maximisation, with expected
counts from a forward-backward pass.  A text's words are its runs of letters in lower
case; pieces never cross words, so a text's score is the sum over its words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from math import exp, inf, log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import packed, unpacked, written

#: Documents of each language that training uses, in expectation; all of them where fewer.
TRAIN_DOCS = 800
#: Units of text that a task remembers at most before it starts afresh, and characters of
#: texts that it scores together.
REMEMBERED, _SLICE = 120_000, 4_000_000
#: From the 32nd letter of a word on, sums are brought back to one after every so many letters,
#: which keeps them in range; words may have any length, pieces up to 40 letters.
PLAIN, EVERY = 32, 2
#: Probability of a single character that is no piece, and mass kept for pieces unseen.
FLOOR, SMOOTH = 1e-7, 0.05
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LETTERS_OR_BREAK = regex.compile(r"\p{L}[\p{L}\p{M}]*|\n")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_STATE: dict = {}


def words_of(unit: str) -> list[str]:
    """The words of a piece of text, each marked at its start."""
    return ["▁" + w for w in _LETTERS.findall(unit.lower())]


def vocabulary_pieces(model_file: str) -> list[str]:
    """The pieces of a SentencePiece vocabulary file that words can contain."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    fits = regex.compile(r"▁?[\p{L}\p{M}]*")
    return sorted({p for p in plain if p and fits.fullmatch(p) and p == p.lower()})


@dataclass(frozen=True)
class LanguageModel:
    """``table[piece]`` holds the piece's probability in each of ``languages``."""

    languages: tuple[str, ...]
    table: dict[str, tuple[float, ...]]

    @property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    def word(self, word: str, longest: int) -> list[float]:
        """Log-probabilities of a word by the forward algorithm."""
        get, langs, floor = self.table.get, range(len(self.languages)), FLOOR
        ahead, scale = [[1.0] * len(self.languages)], [0.0] * len(self.languages)
        for end in range(1, len(word) + 1):
            last = ahead[end - 1]
            p = get(word[end - 1])
            total = [x * floor for x in last] if p is None else [x * y for x, y in zip(last, p)]
            for start in range(max(0, end - longest), end - 1):
                p = get(word[start:end])
                if p is not None:
                    before = ahead[start]
                    for k in langs:
                        total[k] += before[k] * p[k]
            ahead.append(total)
            if end >= PLAIN and end % EVERY == 0:
                scale = [x + log(y) for x, y in zip(scale, total)]
                for at in range(max(0, end + 1 - longest), end + 1):
                    ahead[at] = [x / y for x, y in zip(ahead[at], total)]
        return [x + log(y) for x, y in zip(scale, ahead[-1])]


def expected_counts(word: str, weight: float, p: dict[str, float], longest: int, into: dict[str, float]) -> None:
    """Adds the expected number of each piece in ``word`` to ``into``, by forward-backward."""
    n = len(word)
    arcs = []
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            q = p.get(word[start:end], FLOOR if end - start == 1 else None)
            if q is not None:
                arcs.append((start, end, q))
    if n > PLAIN:
        shares = _long_shares(n, arcs)
    else:
        ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for start, end, q in arcs:
            ahead[end] += ahead[start] * q
        for start, end, q in reversed(arcs):
            back[start] += q * back[end]
        shares = [ahead[start] * q * back[end] / ahead[n] for start, end, q in arcs]
    for (start, end, _), share in zip(arcs, shares):
        piece = word[start:end]
        if piece in p:
            into[piece] = into.get(piece, 0.0) + weight * share


def _long_shares(n: int, arcs: list[tuple[int, int, float]]) -> list[float]:
    """How often each arc is used, by sums of logarithms, which no length takes out of range."""

    def plus(x: float, y: float) -> float:
        high, low = max(x, y), min(x, y)
        return high if low == -inf else high + log(1 + exp(low - high))

    ahead, back = [0.0] + [-inf] * n, [-inf] * n + [0.0]
    for start, end, q in arcs:
        ahead[end] = plus(ahead[end], ahead[start] + log(q))
    for start, end, q in reversed(arcs):
        back[start] = plus(back[start], log(q) + back[end])
    return [exp(ahead[start] + log(q) + back[end] - ahead[n]) for start, end, q in arcs]


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """Rows (lang, word, n) of about ``max_docs`` documents of each language, chosen by a
    hash of their ids; all documents of a language that has no more."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("docs")).collect()  # one row a language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col) == r.lang, F.lit(max_docs / r.docs)).otherwise(share)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("train"), F.col(id_col)), 11).cast("double") / F.lit(float(1 << 53))

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update((lang, w) for w in words_of(text))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    return labelled.where(chance < share).select(lang_col, text_col).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train_language_model(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, rounds: int = 3) -> LanguageModel:
    """Piece probabilities of each language with a label in ``docs``.

    Each round is one Spark job over distinct words with their counts; what reaches the
    driver is at most one number for each language and piece.
    """
    spark = docs.sparkSession
    words = written(training_words(docs, id_col, text_col, lang_col, max_docs).repartition("lang", "word"), "words")
    languages = tuple(sorted(r.lang for r in words.select("lang").distinct().collect()))
    longest = max(map(len, pieces), default=1)
    known = set(pieces)
    start = {p: 1.0 / len(pieces) for p in pieces}
    tables = {lang: start for lang in languages}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(tables)  # languages x pieces of a fixed vocabulary

        def counts(batches):
            into: dict[str, dict[str, float]] = {}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    expected_counts(word, n, shared.value[lang], longest, into.setdefault(lang, {}))
            rows = [(lang, p, c) for lang, some in into.items() for p, c in some.items() if c > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["lang", "piece", "c"])

        summed = words.mapInArrow(counts, "lang string, piece string, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toArrow()
        seen: dict[str, dict[str, float]] = {lang: {} for lang in languages}
        for lang, piece, c in zip(*(summed[x].to_pylist() for x in ("lang", "piece", "c"))):
            seen[lang][piece] = c
        tables = {}
        for lang, some in seen.items():
            whole = sum(some.values()) + SMOOTH * len(known)
            tables[lang] = {p: (some.get(p, 0.0) + SMOOTH) / whole for p in pieces}
        shared.unpersist()
    # Rounded, so that the order of additions cannot show in results.
    joint = {p: tuple(float(f"{tables[lang][p]:.9g}") for lang in languages) for p in pieces}
    return LanguageModel(languages, joint)


class ForwardPass:
    """The forward algorithm over many words at once.

    Substrings are found among the pieces by rolling hashes, one table for each length; a
    bitmap of hash bits answers most look-ups.  Pieces of equal hash are refused at the start.
    """

    def __init__(self, model: LanguageModel):
        by_length: dict[int, list[str]] = {}
        for piece in model.table:
            by_length.setdefault(len(piece), []).append(piece)
        self.groups, self.tables = len(model.languages), {}
        for k, pieces in by_length.items():
            codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.uint64)
            h = np.zeros(len(pieces), np.uint64)
            for j in range(k):
                h = h * _BASE + codes[:, j]
            order = np.argsort(h)
            if (np.diff(h[order]) == 0).any():
                raise ValueError("two pieces of the vocabulary have one hash")
            seen = np.zeros(1 << 16, bool)
            seen[self._low(h)] = True
            p = np.array([model.table[x] for x in pieces], np.float64).reshape(len(pieces), self.groups)
            self.tables[k] = (h[order], p[order], seen)

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(48)).astype(np.int64)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """(word x language), for words of any length, those of like lengths together."""
        out = np.zeros((len(words), self.groups))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        limits = [0, 5, 8, 11, 15, 20, PLAIN]
        while limits[-1] < lengths.max(initial=0):
            limits.append(2 * limits[-1])
        for low, high in zip(limits, limits[1:]):
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            at_once = max(1, 8192 * PLAIN // max(PLAIN, high))
            for part in np.array_split(some, -(-len(some) // at_once)) if len(some) else ():
                out[part] = self._part(codes, starts[part], lengths[part])
        return out

    def _part(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, width = len(starts), int(lengths.max())
        place = np.arange(width)
        # Letters by place, so that all words' letters of one place lie together.
        c = np.where(place[:, None] < lengths, codes[np.minimum(starts + place[:, None], len(codes) - 1)], 0).astype(np.uint64)
        found, h = {}, np.zeros((width, n), np.uint64)
        for k in range(1, min(width, max(self.tables)) + 1):
            h = np.concatenate([np.zeros((1, n), np.uint64), h[:-1]]) * _BASE + c if k > 1 else c.copy()
            if k not in self.tables:
                continue
            keys, p, seen = self.tables[k]
            end, word = np.nonzero(seen[self._low(h[k - 1 :])])
            end += k - 1
            want = h[end, word]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[at] == want) & (end < lengths[word])
            end, word, at = end[hit], word[hit], at[hit]
            found[k] = (np.searchsorted(end, np.arange(width + 1)), word, p[at])
        ahead = np.zeros((width + 1, n, self.groups))
        ahead[0] = 1.0
        out, scale, longest = np.zeros((n, self.groups)), np.zeros((n, self.groups)), max(self.tables)
        for end in range(width):
            total = ahead[end] * FLOOR
            for k, (bounds, word, p) in found.items():
                a, b = bounds[end], bounds[end + 1]
                if k == 1:
                    total[word[a:b]] = ahead[end][word[a:b]] * p[a:b]
                elif a < b:
                    total[word[a:b]] += ahead[end + 1 - k][word[a:b]] * p[a:b]
            ahead[end + 1] = total
            if width > PLAIN:
                over = lengths == end + 1
                out[over] = scale[over] + np.log(total[over])
                if end + 1 >= PLAIN and (end + 1) % EVERY == 0:
                    scale += np.log(total)
                    ahead[max(0, end + 2 - longest) : end + 2] /= total
        return out if width > PLAIN else np.log(ahead[lengths, np.arange(n)])


class _Scorer:
    """Scores texts of one task in slices, and remembers the scores of units met before."""

    def __init__(self, model: LanguageModel):
        self.model, self.ahead = model, ForwardPass(model)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages) + 1))

    def learn(self, units: list[str]) -> None:
        """The last number of a unit's row counts its words."""
        order: dict[str, int] = {}
        place, owner = [], []
        for k in range(0, len(units), 20_000):
            unit = k
            for w in _LETTERS_OR_BREAK.findall("\n".join(units[k : k + 20_000]).lower()):
                if w == "\n":
                    unit += 1
                    continue
                place.append(order.setdefault("▁" + w, len(order)))
                owner.append(unit)
        scores = np.c_[self.ahead.log_probabilities(list(order)), np.ones(len(order))][np.array(place, np.int64)]
        new = np.stack([np.bincount(np.array(owner, np.int64), scores[:, g], len(units)) for g in range(scores.shape[1])], axis=1)
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.rows = np.concatenate([self.rows, new])

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, held, size = [], [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text or "")
            if size >= _SLICE or k == len(texts) - 1:
                out += self._slice(held)
                held, size = [], 0
        return out

    def _slice(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages or not self.model.table:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.at) > REMEMBERED:
            self.forget()
        cut = [(t or "").split() for t in texts]
        new = [u for u in set(chain.from_iterable(cut)) if u not in self.at]
        if new:
            self.learn(new)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        idx = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        total, some = np.zeros((len(cut), self.rows.shape[1])), np.flatnonzero(counts)
        if len(some):
            total[some] = np.add.reduceat(self.rows[idx], (np.cumsum(counts) - counts)[some], axis=0)
        best = total[:, :-1].argmax(axis=1)
        rest = np.exp(np.maximum(-700.0, total[:, :-1] - total[np.arange(len(cut)), best][:, None])).sum(axis=1)
        return [(self.model.languages[b], float(1.0 / r)) if n else (UNKNOWN, 0.0) for b, r, n in zip(best, rest, total[:, -1])]


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior under even priors, 0 to 1.

    Whole texts count.  A null text or one without letters gives ``und`` and 0, as does a
    model without languages; ties go to the first language by name.  No row is dropped, and
    columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x vocabulary
    name = hashlib.sha256(repr((model.languages, sorted(model.table.items()))).encode()).hexdigest()

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        if _STATE.get("name") != name:
            _STATE.update(name=name, scorer=_Scorer(shared.value))
        rows = _STATE["scorer"].texts(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"])

    told = packed(docs, text_col).withColumn("told", of(F.col("text")))
    return unpacked(told, docs, text_col, lang_pred=F.col("told.lang"), score=F.col("told.score"))


def fold(id_col: Column) -> Column:
    """The remainder by 3 of the CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3
