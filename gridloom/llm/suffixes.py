"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, whatever
surrounds it.  Windows of that length are compared where they can be equal, and nowhere else:

1.  Each window has an anchor, the string of KEY bytes in it whose hash is smallest (the first
    of equals).  Equal windows have equal anchors at equal places, so that only windows of one
    class, those with equal anchor strings, can be equal.  Anchors are sparse: all windows of a
    run share one, and a run is one row with a digest of its context, all bytes of its windows.
2.  Classes met once are done.  Equal contexts count as one with a multiplicity.  In a class of
    one context met repeatedly every window is repeated.
3.  Contexts of the other classes meet.  Each class is dealt into shards.  A shard's suffixes are
    sorted and give its Burrows-Wheeler transform over words of a fraction of ``length``: before
    each suffix stands the word that precedes it.  Shards are merged by refining an interleave:
    a list that tells for each merged place only from which shard its suffix comes, first one
    shard after the other.  A round passes the list once and deals its entries out, in order, to
    the words that precede them; afterwards it is sorted by one word more.  Where neighbours part
    for the first time is their common prefix.  After ``length`` bytes of words, neighbours
    that never parted are the repeated intervals.  No suffix of another shard is ever compared.
4.  A class of more than GROUP contexts is cut finer: its runs into shorter ones, whose windows
    have more bytes in common, which makes new classes; runs of one window at last, where equal
    classes are equal windows and are only counted.  So no class of any size meets in one task.

Contexts alone travel between tasks, and spans come back to the texts.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import packed, unpacked, written

LENGTH = 400
#: Contexts of a class that meet in one task.
GROUP = 1024
#: Windows of the runs that too large classes are cut to, one after the other.
FINER = (16, 1)
#: Texts whose digests may be broadcast, so that only these texts travel; more meet by a shuffle of all.
FEW = 200_000
#: Bytes of text that are looked at together, shards of a class, rounds of a merge.
BATCH, SHARDS, ROUNDS = 1 << 18, 4, 4
# Fixed values of the SplitMix64 generator's finaliser; the other two are odd numbers at will.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 24) - 1)


def key_bytes(length: int) -> int:
    """Bytes of an anchor: windows find one among the ``length`` - this + 1 in them."""
    return max(8, length // 6)


# ---------------------------------------------------------------------- hashes
def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


@cache
def _powers(base: int, room: int) -> np.ndarray:
    out = np.full(room, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hashes:
    """Two 64-bit hashes of any substrings of 8 bytes or more, by sums that run on."""

    def __init__(self, data: bytes):
        n, padded = len(data), data + bytes(16)
        self.room = 1 << max(20, len(padded).bit_length())
        eight = np.empty(n + 8, np.uint64)
        for r in range(8):
            eight[r::8] = np.frombuffer(padded, "<u8", len(eight[r::8]), r)
        eight = _mixed(eight)
        self.sums = []
        for k, base in enumerate(_BASES):
            terms = (eight ^ (eight << np.uint64(17)) if k else eight) * _powers(base, self.room)[: len(eight)]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        inverse = _powers(pow(_BASES[which], -1, 1 << 64), self.room)
        return _mixed((self.sums[which][ends - 7] - self.sums[which][starts]) * inverse[starts])


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours from each place on, by minima that run on within
    blocks of that width, forward and backward."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs_of(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, class, digest, digest): runs of windows with one anchor, by their
    first and last start in ``data``, texts one after the other that end at ``ends``."""
    key = key_bytes(length)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    h = Hashes(data)
    at = np.arange(len(data) - key + 1)
    name = h.of(at, at + key, 0)
    low = _smallest((name & ~_PLACE) | at.astype(np.uint64), length - key + 1)
    starts = np.arange(len(low))
    starts = starts[starts + length <= ends[np.searchsorted(ends, starts, "right")]]
    anchor = (low[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1] if len(starts) else starts
    anchor = anchor[heads]
    shape = ((anchor - first) << 32 | (last - first)).astype(np.uint64)
    return first, last, anchor, name[anchor], *[_mixed(h.of(first, last + length, k) ^ _mixed(shape)) for k in (0, 1)]


# --------------------------------------------------------------- merged shards
def shard_transform(symbols: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order, and the symbol before each.  ``ahead`` and ``behind`` are the
    places a word further and a word back, ``ahead`` -1 where a suffix is its end alone; the end is a
    symbol too, and stands before a whole text.  Ranks of longer and longer prefixes, doubled
    each time, sort them."""
    n = len(symbols)
    rank, far = symbols.astype(np.int64), ahead
    while (far >= 0).any():
        beyond = np.where(far >= 0, rank[far] + 1, 0)
        rank = np.unique(rank * (beyond.max() + 1) + beyond, return_inverse=True)[1].ravel()
        far = np.where(far >= 0, far[far], -1)
    order = np.argsort(rank, kind="stable")
    return order, symbols[behind[order]] if n else symbols


def merged_intervals(transforms: list[np.ndarray], ends: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For the merged suffixes of shards: from which shard each comes, and its interval, equal for
    those whose first ``rounds`` symbols are; ``ends`` marks the symbols that are ends."""
    sizes = [len(t) for t in transforms]
    before = np.concatenate(transforms)
    source, interval = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes), np.zeros(sum(sizes), np.int64)
    for _ in range(rounds):
        word = np.empty_like(before)
        word[np.argsort(source, kind="stable")] = before  # each shard's own are read in order
        dealt = np.argsort(word, kind="stable")
        source, word, interval = source[dealt], word[dealt], interval[dealt]
        part = np.ones(len(word), bool)  # whether one parts from its predecessor
        part[1:] = (word[1:] != word[:-1]) | ((interval[1:] != interval[:-1]) & ~ends[word[1:]])
        interval = np.cumsum(part)
    return source, interval


def repeated_windows(groups: np.ndarray, texts: list[bytes], counts: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each text, the sorted starts of its windows that are met twice or more within its
    group, a text being met ``counts`` times."""
    word = next(d for d in range(max(1, length // ROUNDS), 0, -1) if length % d == 0)
    h, sizes = Hashes(b"".join(texts)), np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    # Every place of a text and its end is a suffix; the last ``word`` of them hold no word.
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    left = sizes[text] - place
    whole = left >= word
    name = np.empty((2, len(text)), np.uint64)
    start = (stops - sizes)[text] + place
    salt = _mixed(groups.astype(np.uint64))[text]
    for k in (0, 1):
        if word >= 8:
            name[k][whole] = _mixed(h.of(start[whole], start[whole] + word, k) ^ salt[whole])
        else:  # short words as they are
            raw = np.frombuffer(b"".join(texts), np.uint8)
            short = sum(raw[start[whole] + j].astype(np.uint64) << np.uint64(8 * j) for j in range(word))
            name[k][whole] = _mixed(short + np.uint64(k + 1) ^ salt[whole])
        name[k][~whole] = _mixed(salt[~whole] + np.uint64(k + 3))
    order = np.lexsort(name)
    new = np.ones(len(order), bool)
    new[1:] = (name[:, order[1:]] != name[:, order[:-1]]).any(axis=0)
    symbols = np.empty(len(order), np.int64)
    symbols[order] = np.cumsum(new) - 1
    ends = np.zeros(symbols.max() + 1, bool)
    ends[symbols[~whole]] = True
    heads = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
    number = np.arange(len(texts)) - np.repeat(heads, np.diff(np.append(heads, len(texts))))
    shard = (number % shards)[text]
    transforms, suffixes = [], []
    for s in range(shards):
        mine = np.flatnonzero(shard == s)
        at = np.empty(len(text), np.int64)
        at[mine] = np.arange(len(mine))
        ahead = np.where(whole[mine], at[np.minimum(mine + word, len(text) - 1)], -1)
        # Before a whole text stands its end, which is the last place of the text.
        last = mine + left[mine]
        behind = at[np.where(place[mine] >= word, mine - word, last)]
        found, before = shard_transform(symbols[mine], ahead, behind)
        suffixes.append(mine[found])
        transforms.append(before)
    source, interval = merged_intervals(transforms, ends, length // word)
    merged = np.empty(len(text), np.int64)
    merged[np.argsort(source, kind="stable")] = np.concatenate(suffixes)
    met = np.zeros(interval[-1] + 1, np.int64)
    window = left[merged] >= length
    np.add.at(met, interval[window], counts[text[merged[window]]])
    again = np.sort(merged[window][met[interval[window]] > 1])
    return np.split(place[again], np.searchsorted(text[again], np.arange(1, len(texts))))


# ---------------------------------------------------------------------- stages
def _slices(column, length):
    """Texts in lists of about BATCH bytes, with (place in the column, offset) of each; long ones in
    pieces that overlap by all but one byte of a window."""
    held, size, rows = [], 0, []
    for k, t in enumerate(column):
        t = t.as_py() or b""
        for at in range(0, max(len(t) - length + 1, 0), BATCH):
            piece = t[at : at + BATCH + length - 1]
            held.append(piece)
            rows.append((k, at))
            size += len(piece)
            if size >= BATCH:
                yield held, rows
                held, size, rows = [], 0, []
    if held:
        yield held, rows


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """Rows (doc, run, c, x1, x2) of the runs of all texts, ``run`` as ``_unpacked`` reads it, and for
    each text one row without a class that tells its digests x1 and x2.  Numbers of texts go on
    within a task: they are short, unlike digests, and say no more than that row does."""

    def rows(batches):
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(doc, doc + n)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *batch.columns[:2]], names)
            for pieces, places in _slices(batch.column(2), length):
                ends = np.cumsum([len(p) for p in pieces])
                first, last, anchor, *digests = runs_of(b"".join(pieces), ends, length)
                piece = np.searchsorted(ends, first, "right")
                row, at = (np.array(x) for x in zip(*places))
                run = ((first + (at - ends + [len(p) for p in pieces])[piece]) * length + last - first) * length + anchor - first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc + row[piece], run, *[d.view(np.int64) for d in digests])], names)
            doc += n

    names = ["doc", "run", "c", "x1", "x2"]
    return texts.select("d1", "d2", "text").mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _unpacked(length: int) -> list[Column]:
    """s0, s1 and a, the first and last start and the anchor of ``run``."""
    s0 = F.expr(f"run div {length * length}L")
    return [s0.alias("s0"), (s0 + F.expr(f"run div {length}L % {length}L")).alias("s1"), (s0 + F.expr(f"run % {length}L")).alias("a")]


def _with_texts(texts: DataFrame, wanted: DataFrame, columns: list[str], few: bool) -> DataFrame:
    """Rows (text, wanted): for each text the list of what is wanted of it.  Where ``few`` texts are
    expected, the others are left out before any text travels."""
    lists = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    lists = written(lists.withColumnsRenamed({"d1": "_1", "d2": "_2"}), "wanted")
    if few and lists.count() <= FEW:
        keys = lists.select(F.col("_1").alias("k1"), F.col("_2").alias("k2"))
        texts = texts.join(F.broadcast(keys), (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left_semi")
    return texts.join(lists, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))).select("text", "wanted", "d1", "d2")


def _met(texts: DataFrame, contexts: DataFrame, length: int, few: bool) -> DataFrame:
    """Rows (c, x1, x2, lo, hi): ranges of windows of contexts (c, x1, x2, n, d1, d2, s0, s1) that
    are repeated within their class, counted from the context's first."""

    def cut(batches):
        seen = set()  # copies of a text, which the join brings together, give the same pieces
        for batch in batches:
            out = []
            for text, wanted, d1, d2 in zip(*batch.columns):
                if (d1.as_py(), d2.as_py()) in seen:
                    continue
                seen.add((d1.as_py(), d2.as_py()))
                t = text.as_py()
                out += [(w["c"], w["x1"], w["x2"], w["n"], t[w["s0"] : w["s1"] + length]) for w in wanted.as_py()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["c", "x1", "x2", "n", "bytes"])

    def merged(batches):
        held, size = [], 0

        def out(rows):
            found = repeated_windows(np.array([r[0] for r in rows]), [r[4] for r in rows], np.array([r[3] for r in rows]), length)
            done = []
            for r, starts in zip(rows, found):
                cuts = np.flatnonzero(np.diff(starts) > 1)
                if len(starts):
                    done += [(*r[:3], lo, hi) for lo, hi in zip(starts[[0, *(cuts + 1)]].tolist(), starts[[*cuts, -1]].tolist())]
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(5)], ["c", "x1", "x2", "lo", "hi"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:3] == r[:3]:  # a copy from another task
                    continue
                if size >= BATCH and held[-1][0] != r[0]:
                    yield out(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield out(held)

    pieces = _with_texts(texts, contexts, ["c", "x1", "x2", "n", "s0", "s1"], few).mapInArrow(cut, "c long, x1 long, x2 long, n long, bytes binary")
    return pieces.repartition("c").sortWithinPartitions("c", "x1", "x2").mapInArrow(merged, "c long, x1 long, x2 long, lo long, hi long")


def _finer(texts: DataFrame, contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Runs of at most ``width`` windows of the contexts' runs, as rows (h, h1, h2, off, n, d1, d2,
    s0, s1, a, c, x1, x2): the context they come from, and theirs."""

    def rows(batches):
        for batch in batches:
            for text, wanted, d1, d2 in zip(*batch.columns):
                t, held, size = text.as_py(), [], 0
                for w in wanted.as_py():
                    held.append(w)
                    size += w["s1"] + length - w["s0"]
                    if size >= BATCH:
                        yield cut(t, held, d1.as_py(), d2.as_py())
                        held, size = [], 0
                if held:
                    yield cut(t, held, d1.as_py(), d2.as_py())

    def cut(t, some, d1, d2):
        out, shift = [], 0  # from places in the text to places in the contexts, one after the other
        for w in some:
            a, s0, s1 = w["a"], w["s0"], w["s1"]
            # By their distance to the anchor: equal windows are in runs of equal number.
            for j in range((a - s1) // width, (a - s0) // width + 1):
                lo, hi = max(s0, a - j * width - width + 1), min(s1, a - j * width)
                out.append((w["h"], w["h1"], w["h2"], w["off"] + lo - s0, w["n"], d1, d2, lo, hi, a, w["c"], j, shift - s0))
            shift += s1 + length - s0
        cols = [np.array([o[k] for o in out]) for k in range(13)]
        lo, hi, a, c, j, move = cols[7:]
        core, shape = a - j * width + move, ((a - lo) << 32 | (hi - lo)).astype(np.uint64)
        h = Hashes(b"".join(t[w["s0"] : w["s1"] + length] for w in some))
        name = h.of(core, core - width + 1 + length, 0) ^ _mixed(c.view(np.uint64) + j.astype(np.uint64))
        digests = [_mixed(h.of(lo + move, hi + move + length, k) ^ _mixed(shape)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols[:10], *[_mixed(x).view(np.int64) for x in (name, *digests)])], names)

    names = ["h", "h1", "h2", "off", "n", "d1", "d2", "s0", "s1", "a", "c", "x1", "x2"]
    wanted = _with_texts(texts, contexts, ["h", "h1", "h2", "off", "n", "s0", "s1", "a", "c"], True)
    # Copies of a text give the same runs.
    return wanted.mapInArrow(rows, ", ".join(f"{n} long" for n in names)).distinct()


def repeated_ranges(texts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Rows (d1, d2, found): the spans (start, stop) of repeated windows of ``texts`` (d1, d2, text:
    digests that tell texts apart, and bytes), overlapping ones among them.  Copies of a text
    have the same spans, and one row."""
    runs = written(_runs(texts, length), "runs")
    names = runs.where("c is null").select("doc", F.col("x1").alias("d1"), F.col("x2").alias("d2"))
    runs = runs.where("c is not null")
    met = written(runs.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "classes")
    shared = written(runs.join(met, "c", "left_semi"), "shared")
    items = shared.groupBy("c", "x1", "x2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "run")).alias("at")).select("c", "x1", "x2", "n", "at.doc", "at.run")
    place, home = ["d1", "d2", "s0", "s1", "a"], [F.col("c").alias("h"), F.col("x1").alias("h1"), F.col("x2").alias("h2")]
    items = items.join(names, "doc").select("c", "x1", "x2", "n", "d1", "d2", *_unpacked(length), *home, F.lit(0).cast("long").alias("off"))
    located = lambda rows: rows.groupBy("c", "x1", "x2").agg(F.sum("n").alias("n"), F.min(F.struct(*place)).alias("at")).select("c", "x1", "x2", "n", *[F.col(f"at.{p}").alias(p) for p in place])
    items, found = written(items, "items"), []
    for width in (*FINER, None):
        # Contexts of one content, from whatever runs they were cut, and classes by their number.
        contexts = items if not found else written(located(items), "contexts")
        sizes = contexts.groupBy(F.col("c").alias("_c")).agg(F.count("*").alias("different"), F.sum("n").alias("met"))
        sizes = written(sizes.where("met > 1"), "sizes")
        of = lambda rows, test: rows.join(sizes.where(test).select("_c"), F.col("c") == F.col("_c")).drop("_c")
        found.append(of(items, "different = 1").select("h", "h1", "h2", F.col("off").alias("lo"), (F.col("off") + F.col("s1") - F.col("s0")).alias("hi")))
        some = _met(texts, of(contexts, f"different between 2 and {group}"), length, width != FINER[0]).withColumnsRenamed({"c": "m", "x1": "m1", "x2": "m2"})
        some = written(some, "met")
        here = items.join(some, (F.col("c") == F.col("m")) & (F.col("x1") == F.col("m1")) & (F.col("x2") == F.col("m2")))
        found.append(here.select("h", "h1", "h2", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi")))
        many = written(of(items, f"different > {group}"), "many")
        if width is None or many.isEmpty():
            break
        items = written(_finer(texts, many, width, length), "items")
    ranges = written(reduce(DataFrame.union, found), "ranges")
    back = shared.join(ranges, (F.col("c") == F.col("h")) & (F.col("x1") == F.col("h1")) & (F.col("x2") == F.col("h2")))
    s0 = _unpacked(length)[0]
    spans = back.groupBy("doc").agg(F.collect_set(F.struct((s0 + F.col("lo")).alias("start"), (s0 + F.col("hi") + length).alias("stop"))).alias("found"))
    return spans.join(names, "doc").groupBy("d1", "d2").agg(F.first("found").alias("found"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``docs`` with ``spans`` (array of (start, stop), bytes that are repeated, as maximal runs) and
    ``kept`` (binary, the rest) added, from the UTF-8 bytes of ``text_col``.

    Strings are judged on the texts as they are: all their occurrences go, also the first, and
    also those that overlap.  Every row is a document of its own, repeated rows too, so that
    texts of ``length`` bytes or more that occur twice go whole.  Null and shorter texts have no spans; an
    empty table stays empty.  Columns named like those added are replaced.
    """
    rows = packed(docs, text_col)
    digests = [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2")]
    texts = rows.select(F.col("text").cast("binary").alias("text"), *digests).where(F.length("text") >= length)
    spans = repeated_ranges(texts, length, group).withColumnsRenamed({"d1": "_1", "d2": "_2"})
    known = rows.select("row", "text", *digests).join(written(spans, "spans"), (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")

    def cut(batches):
        for batch in batches:
            rows, texts, found = batch.columns
            spans, kept = [], []
            for data, some in zip(texts, found):
                data, runs = data.as_py(), []
                for s in sorted((s["start"], s["stop"]) for s in some.as_py() or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                spans.append([dict(zip(("start", "stop"), r)) for r in runs])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)])))
            yield pa.RecordBatch.from_arrays([rows, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["row", "spans", "kept"])

    whole = known.select(F.struct("row", "text").alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"), "found")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    out = whole.mapInArrow(cut, T.StructType([whole.schema["row"], T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]))
    return unpacked(out.select(F.col("row.row").alias("row"), F.col("row.text").alias("text"), "spans", "kept"), docs, text_col, spans=F.col("spans"), kept=F.col("kept"))
