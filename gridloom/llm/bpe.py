"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

Frequent words, counted over all documents, are compiled with their token ids into a
minimal acyclic transducer: equal suffixes share states, and the numbers on a word's arcs
add up to the place of its ids.  Tasks map its bytes into memory and look words up there;
any other word is merged exactly, so the lexicon changes speed and never results.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
import unicodedata
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in the lexicon at most.
LEXICON_WORDS = 65536
#: Words, and units, that a task remembers at most before it starts afresh.
REMEMBERED = 120_000
#: Characters that are encoded together, and bytes of words that are merged together.
_SLICE, _SHORT = 4_000_000, 48
_NONE = 1 << 30
_STATE: dict = {}


# ------------------------------------------------------------------ transducer
class Transducer:
    """A minimal acyclic transducer over byte strings, in one flat block of bytes.

    Layout: counts (states, arcs, words, ids), then int32 arrays first_arc[states + 1],
    target[arcs], add[arcs], ids_from[words + 1], ids[ids], and bytes final[states],
    label[arcs].  A word's number is the sum of ``add`` along its path.
    """

    def __init__(self, block):
        head = memoryview(block)[:16].cast("i")
        states, arcs, words, ids = head
        at, parts = 16, []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(memoryview(block)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.add, self.ids_from, self.ids = parts
        self.final = memoryview(block)[at : at + states]
        self.block, self.labels_at = block, at + states
        self.states, self.words = states, words

    def __getitem__(self, word: bytes) -> tuple[int, ...] | None:
        """The ids of a word, or None."""
        state, number, base, find = 0, 0, self.labels_at, self.block.find
        for k in range(len(word)):
            a = find(word[k : k + 1], base + self.first[state], base + self.first[state + 1]) - base
            if a < 0:
                return None
            number += self.add[a]
            state = self.target[a]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.ids_from[number] : self.ids_from[number + 1]])


class BatchLookup:
    """Looks many words up at once in a transducer: a step for each byte place."""

    def __init__(self, t: Transducer):
        first = np.asarray(t.first)
        label = np.frombuffer(t.block, np.uint8, count=first[-1], offset=t.labels_at)
        self.keys = np.repeat(np.arange(t.states, dtype=np.int64), np.diff(first)) << 8 | label  # sorted: arcs lie by state and label
        self.target, self.add, self.final = np.asarray(t.target), np.asarray(t.add), np.asarray(t.final)
        self.ids_from, self.ids = np.asarray(t.ids_from), np.asarray(t.ids)

    def numbers(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word, flat[start : start + length], or -1."""
        out, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        for k in range(int(lengths.max(initial=0))):
            live = live[(out[live] >= 0) & (lengths[live] > k)]
            if not len(live):
                break
            want = state[live] << 8 | flat[starts[live] + k]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[arc] == want
            out[live] = np.where(hit, out[live] + self.add[arc], -1)
            state[live] = self.target[arc]
        out[(out >= 0) & (self.final[state] == 0)] = -1
        return out


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def compile_transducer(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The block of the minimal transducer of ``entries``, built from sorted words with a
    register of finished states."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, state), ...)), children first

    def finished(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in register:
            register[shape] = len(states)
            states.append(shape)
        return register[shape]

    path, before = [[False, []]], b""
    words = sorted(entries)
    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        for k in range(len(before), common, -1):
            done = finished(path.pop())
            path[-1][1].append((before[k - 1], done))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        before = word
    for k in range(len(before), 0, -1):
        done = finished(path.pop())
        path[-1][1].append((before[k - 1], done))
    root = finished(path[0])

    below = []
    for final, arcs in states:
        below.append(final + sum(below[s] for _, s in arcs))
    place = {root: 0}
    place |= {s: k + 1 for k, s in enumerate(s for s in range(len(states)) if s != root)}
    order = sorted(place, key=place.get)
    first, target, add, label, final = array("i", [0]), array("i"), array("i"), bytearray(), bytearray()
    for s in order:
        is_final, arcs = states[s]
        seen = int(is_final)
        for byte, to in arcs:
            label.append(byte)
            target.append(place[to])
            add.append(seen)
            seen += below[to]
        final.append(is_final)
        first.append(len(target))
    ids_from, ids = array("i", [0]), array("i")
    for word in words:
        ids.extend(entries[word])
        ids_from.append(len(ids))
    head = array("i", [len(order), len(target), len(words), len(ids)])
    return b"".join(bytes(x) for x in (head, first, target, add, ids_from, ids, final, label))


def mapped(block: bytes) -> mmap.mmap:
    """The bytes in a nameless temporary file, mapped into memory for reading."""
    with tempfile.TemporaryFile() as f:
        f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


# ------------------------------------------------------------------- tokenizer
def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE as a tokenizer file declares it: one split pattern, byte letters, ranked
    merges, and added tokens cut out of the text first.  Other kinds of file are refused."""

    def __init__(self, declared: str):
        spec = json.loads(declared)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre != {**pre, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"] or model["dropout"]:
            raise ValueError("not a plain byte-level BPE tokenizer file")
        vocab, letters = model["vocab"], _byte_letters()
        back = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.base = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pairs = np.array([a << 20 | b for a, b in self.merges], np.int64)
        self.pair_order = np.argsort(pairs)
        self.pair_keys = pairs[self.pair_order]  # in rank order before sorting, as dictionaries keep it
        self.made = np.array([new for _, new in self.merges.values()], np.int32)
        self.base_ids = np.array(self.base, np.int32)
        self.added = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that look around themselves are not supported")
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        late = _late()
        self.late = re.compile(f"[{late}]") if late else None
        # One range finds the few texts in which the many of the other can matter at all.
        self.high = re.compile(f"[{late[:10]}-\\U0010ffff]") if late else None
        self.pattern = regex.compile(_pattern(""))
        self.exact_pattern = regex.compile(_pattern(late))
        self.odd_space = regex.compile(r" (?:\s|$)")

    def split(self, text: str) -> list[str]:
        """Words by the split pattern; the plain pattern where it is exact, which is nearly always."""
        exact = text.isascii() or self.late is None or not self.high.search(text) or not self.late.search(text)
        return (self.pattern if exact else self.exact_pattern).findall(text)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word by exact merging: always the pair of least rank, leftmost first."""
        ids, merges, none = [self.base[b] for b in word], self.merges, (1 << 30, 0)
        ranks = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = merges.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = merges.get((ids[k], ids[k + 1]), none)
        return tuple(ids)

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """As ``merge``, for words of any length: a heap of pairs over a linked list."""
        ids, n, get = [self.base[b] for b in word], len(word), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heap = [(rank, k, a, b, new) for rank, new, k, a, b in heap]
        heapify(heap)
        while heap:
            _, k, a, b, new = heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            ids[k], ids[right] = new, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left, here in ((before[k], k), (k, after[k])):
                if left >= 0 and here < n and (m := get((ids[left], ids[here]))):
                    heappush(heap, (m[0], left, ids[left], ids[here], m[1]))
        return tuple(i for i in ids if i >= 0)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == want) & (b >= 0), self.pair_order[at], _NONE)

    def merge_many(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short words of similar length, padded by -1, and their numbers: each
        round merges the best pair of every word that still has one."""
        width = int(lengths.max())
        place = np.arange(width)
        inside = place < lengths[:, None]
        ids = np.where(inside, self.base_ids[flat[np.minimum(starts[:, None] + place, len(flat) - 1)]], -1)
        count = lengths.copy()
        if width == 1:
            return ids, count
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        while True:
            best = ranks[live].argmin(axis=1)
            rank = ranks[live, best]
            some = rank < _NONE
            live, best, rank = live[some], best[some], rank[some]
            if not len(live):
                return ids, count
            moved = np.minimum(place + (place > best[:, None]), width - 1)
            x = np.take_along_axis(ids[live], moved, axis=1)
            x[:, -1] = -1
            x[np.arange(len(live)), best] = self.made[rank]
            y = np.take_along_axis(ranks[live], np.minimum(moved[:, :-1], width - 2), axis=1)
            y[:, -1] = _NONE
            row = np.arange(len(live))
            for k in (best - 1, best):
                ok = (k >= 0) & (k < width - 1)
                y[row[ok], k[ok]] = self._ranks(x[row[ok], k[ok]], x[row[ok], k[ok] + 1])
            ids[live], ranks[live] = x, y
            count[live] -= 1

    def units(self, text: str) -> list[str]:
        """Pieces of a text that hold whole words each: a space starts a piece where a visible
        character follows, which is always a boundary of the split pattern."""
        if self.odd_space.search(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def _late() -> str:
    """Ranges of letters and digits of the regex library that ``unicodedata`` of the running
    Python, which the tokenizer's Unicode version matches, does not know yet."""
    known = regex.compile(r"[\p{L}\p{N}]")
    late = {c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))}
    starts, stops = sorted(c for c in late if c - 1 not in late), sorted(c for c in late if c + 1 not in late)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops))


def _pattern(late: str) -> str:
    r"""The public split pattern of the byte-level pre-tokenizer; ``late`` code points count as
    neither letters nor digits."""
    letter, digit = (rf"[\p{{{c}}}--[{late}]]" if late else rf"\p{{{c}}}" for c in "LN")
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes texts of one task in slices, and remembers the ids of units met before.

    A unit's ids lie in one flat array.  New units of a slice are cut into words together;
    their distinct words are looked up in the lexicon together, and the rest merged together.
    """

    def __init__(self, bpe: ByteBpe, lexicon: Transducer | None):
        self.bpe, self.lexicon = bpe, BatchLookup(lexicon) if lexicon and lexicon.words else None
        self.forget()

    def forget(self) -> None:
        """Only added tokens stay; as units they are integers, which no text is."""
        added = sorted(set(self.bpe.added.values()))
        self.at: dict = {i: k for k, i in enumerate(added)}
        self.flat = np.array(added, np.int32)
        self.starts, self.lengths = np.arange(len(added)), np.ones(len(added), np.int64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, as (flat, starts, lengths)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(words), np.uint8)
        number = self.lexicon.numbers(raw, starts, np.where(lengths <= _SHORT, lengths, 0)) if self.lexicon else np.full(len(words), -1)
        number[lengths > _SHORT] = -1
        known = np.flatnonzero(number >= 0)
        from_, out_start, out_length = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size = 0
        if len(known):
            first = self.lexicon.ids_from[number[known]].astype(np.int64)
            n = self.lexicon.ids_from[number[known] + 1] - first
            from_.append(gathered(self.lexicon.ids, first, n))
            out_start[known], out_length[known], size = np.cumsum(n) - n, n, int(n.sum())
        new = np.flatnonzero(number < 0)
        for low, high in zip((0, 4, 8, 12, 16, 24), (4, 8, 12, 16, 24, _SHORT)):
            some = new[(lengths[new] > low) & (lengths[new] <= high)]
            for part in np.array_split(some, -(-len(some) // 20_000)) if len(some) else ():
                ids, n = self.bpe.merge_many(raw, starts[part], lengths[part])
                from_.append(ids[ids >= 0])
                out_start[part], out_length[part] = size + np.cumsum(n) - n, n
                size += int(n.sum())
        for k in new[lengths[new] > _SHORT]:
            ids = self.bpe.merge_long(words[k])
            from_.append(np.array(ids, np.int32))
            out_start[k], out_length[k], size = size, len(ids), size + len(ids)
        return np.concatenate([np.zeros(0, np.int32), *from_]).astype(np.int32), out_start, out_length

    def learn(self, units: list[str]) -> None:
        """Remembers new units, each of which starts where words start."""
        order: dict[str, int] = {}
        place, per_unit = [], []
        joined, alone = [u for u in units if _joins(u)], [u for u in units if not _joins(u)]
        units = joined + alone
        for text in [*(joined[k : k + 20_000] for k in range(0, len(joined), 20_000)), *([u] for u in alone)]:
            words = self.bpe.split("".join(text))
            place.extend([order.setdefault(w, len(order)) for w in words])
            # Words and units end together: a unit's words are those that end within it.
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            per_unit.append(np.diff(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, text), np.int64, len(text))), side="right"), prepend=0))
        flat, starts, lengths = self.words([w.encode() for w in order])
        place = np.array(place, np.int64)
        ids = gathered(flat, starts[place], lengths[place])
        ends = np.cumsum(np.concatenate(per_unit))
        total = np.r_[0, np.cumsum(lengths[place])][np.r_[0, ends]]
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.starts = np.concatenate([self.starts, len(self.flat) + total[:-1]])
        self.lengths = np.concatenate([self.lengths, np.diff(total)])
        self.flat = np.concatenate([self.flat, ids])

    def units(self, text: str | None) -> list:
        if not text:
            return []
        if not (self.bpe.cut and self.bpe.cut.search(text)):
            return self.bpe.units(text)
        out, at = [], 0
        for m in self.bpe.cut.finditer(text):
            out += [*(self.bpe.units(text[at : m.start()]) if m.start() > at else ()), self.bpe.added[m[0]]]
            at = m.end()
        return out + (self.bpe.units(text[at:]) if at < len(text) else [])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        flat, counts, held, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text or "")
            if size >= _SLICE or k == len(texts) - 1:
                for out, got in zip((flat, counts), self._slice(held)):
                    out.append(got)
                held, size = [], 0
        return np.concatenate(flat), np.concatenate(counts)

    def _slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > REMEMBERED or len(self.flat) > 20 * REMEMBERED:
            self.forget()
        cut = [self.units(t) for t in texts]
        new = [u for u in set(chain.from_iterable(cut)) if u not in self.at]
        if new:
            self.learn(new)
        idx = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        lengths = self.lengths[idx]
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return gathered(self.flat, self.starts[idx], lengths), np.diff(total[np.r_[0, ends]])


def _joins(unit: str) -> bool:
    """Whether a unit starts with a space before a visible character, which always starts a word."""
    return len(unit) > 1 and unit[0] == " " and not unit[1].isspace()


class _Shared:
    """A bounded value broadcast once, with a digest that names it in worker processes."""

    def __init__(self, spark, value: str | bytes):
        self.name = hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()
        self.held = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.held.value


def _shared(spark, vocabulary: str) -> _Shared:
    with open(vocabulary, encoding="utf-8") as f:
        return _Shared(spark, f.read())  # a vocabulary file: some megabytes


def _bpe(declared: _Shared) -> ByteBpe:
    """The tokenizer of a broadcast file, made once for each worker process."""
    key = ("bpe", declared.name)
    if key not in _STATE:
        _STATE[key] = ByteBpe(declared.value)
    return _STATE[key]


# ------------------------------------------------------------------- operators
def word_counts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Rows (word, n): how often words of the split pattern occur in all texts.

    Texts are cut at single spaces and counted as such, and only distinct pieces are cut into
    words; a piece counts as following a space, so the first word of a text counts as if it did.
    Only words of over 64 characters are left out, which the lexicon cannot hold; pieces may
    have any length.
    """
    declared = _shared(docs.sparkSession, vocabulary)
    units = docs.select(F.explode(F.split(text_col, " ")).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))

    def words(batches):
        bpe = _bpe(declared)
        for batch in batches:
            total: dict[str, int] = {}
            for unit, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in bpe.split(" " + unit):
                    total[w] = total.get(w, 0) + n
            kept = [w for w in total if len(w) <= 64]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([total[w] for w in kept], pa.int64())], ["word", "n"])

    return units.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The transducer of the ``size`` most frequent words.  Its size is bounded: at most
    ``size`` words of at most 64 characters."""
    top = word_counts(docs, vocabulary, text_col).orderBy(F.desc("n"), "word").limit(size).toArrow()
    with open(vocabulary, encoding="utf-8") as f:
        bpe = ByteBpe(f.read())
    words = [w.encode() for w in top["word"].to_pylist()]
    return compile_transducer({w: bpe.merge(w) for w in words})


def _by_slices(docs: DataFrame, size_of, columns: dict[str, T.DataType], work) -> DataFrame:
    """``docs`` with columns made by ``work`` from a record batch, in tasks, a slice at a time:
    rows that together hold some megabytes, so that memory is bounded by the longest text."""
    kept = [f for f in docs.schema.fields if f.name not in columns]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in columns.items()])
    names = [f.name for f in docs.schema.fields]

    def run(batches):
        for batch in batches:
            size = np.cumsum(size_of(batch, names))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _SLICE, side="right")))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(f.name)) for f in kept), *work(part, names)], schema.names)
                a = b

    return docs.mapInArrow(run, schema)


def _encoder(declared: _Shared, block: _Shared | None) -> Encoder:
    key = ("encoder", declared.name, block.name if block else None)
    if key not in _STATE:
        for old in [k for k in _STATE if k[0] == "encoder"]:
            del _STATE[old]
        _STATE[key] = Encoder(_bpe(declared), Transducer(mapped(block.value)) if block else None)
    return _STATE[key]


def _text_sizes(text_col: str):
    return lambda batch, names: pc.utf8_length(batch.column(names.index(text_col))).fill_null(0).to_numpy(zero_copy_only=False)


def _ids_array(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))


def _decoded(bpe: ByteBpe, flat: np.ndarray, counts) -> pa.Array:
    table, out, at = bpe.bytes_of.__getitem__, [], 0
    for n in counts:
        out.append(b"".join(map(table, flat[at : at + n].tolist())).decode("utf-8", "replace"))
        at += n
    return pa.array(out, pa.string())


def encode_texts(docs: DataFrame, vocabulary: str, lexicon: bytes | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` (array of int), the tokens of each whole text, and with
    ``decoded_col``, if named, the text decoded from these ids by the same task.

    Strings of added tokens within a text become those tokens.  A null or empty text has no
    tokens and decodes to an empty text, repeated rows have equal results, an empty table
    stays empty, and existing columns of these names are replaced.
    """
    declared = _shared(docs.sparkSession, vocabulary)
    block = _Shared(docs.sparkSession, lexicon) if lexicon else None  # bounded: see build_lexicon

    def work(part: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
        encoder = _encoder(declared, block)
        flat, counts = encoder.encode(part.column(names.index(text_col)).to_pylist())
        return [_ids_array(flat, counts), *([_decoded(encoder.bpe, flat, counts)] if decoded_col else ())]

    columns = {ids_col: T.ArrayType(T.IntegerType()), **({decoded_col: T.StringType()} if decoded_col else {})}
    return _by_slices(docs, _text_sizes(text_col), columns, work)


def decode_ids(docs: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``, the text of the tokens in ``ids_col``, added tokens included.

    Null gives an empty text; bytes that are not UTF-8 become U+FFFD; an id outside the
    vocabulary fails.
    """
    declared = _shared(docs.sparkSession, vocabulary)

    def sizes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return 3 * pc.list_value_length(batch.column(names.index(ids_col))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def work(part: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
        ids = part.column(names.index(ids_col))
        return [_decoded(_bpe(declared), ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).fill_null(0).to_pylist())]

    return _by_slices(docs, sizes, {text_col: T.StringType()}, work)
