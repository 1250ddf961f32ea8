"""Secret scans: fixed patterns, and Markov models of characters for what they miss.
DataFrame functions only.

Two first-order character models, of random strings and of ordinary identifiers, are
trained from labelled samples; a token whose log-likelihood ratio is high enough is
reported as a span of kind ``markov`` unless a pattern's span overlaps it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import packed, unpacked

# The kinds and their patterns.  For ``access`` and ``hex`` a run of at least
# the wanted length is what a run of any length that passes the length test is.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_STATES = len(ALPHABET) + 1  # state 0 is the start
#: Documents that the labelled samples of ``corpus_samples`` come from at most.
SAMPLE_DOCS = 2000
#: Shortest token that the models judge, and the least log-likelihood ratio in nats.
MIN_LENGTH, THRESHOLD = 20, 12.0


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratios of transitions, row-major over 1 + len(ALPHABET) states."""

    ratios: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """The ratio of a token in nats; characters outside the alphabet restart the model."""
        # A foldable expression, which the optimizer turns into one array literal.
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        states = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        return F.aggregate(
            states,
            F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")),
            lambda acc, s: F.struct(s.alias("at"), (acc["sum"] + F.when(s == 0, 0.0).otherwise(F.get(table, acc["at"] * _STATES + s))).alias("sum")),
            lambda acc: acc["sum"],
        )


def train_secret_model(samples: DataFrame, smoothing: float = 0.5) -> SecretModel:
    """From rows (token string, secret boolean).  Only transition counts, at most two for
    each pair of states, reach the driver.  Nulls and empty tokens teach nothing; without
    samples of a class its model is uniform."""
    states = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    moves = F.transform("states", lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.get("states", i - 1)).alias("a"), s.alias("b")))
    counts = (
        samples.where("token is not null and token != '' and secret is not null")
        .select("secret", states.alias("states"))
        .select("secret", F.inline(moves))
        .where("b > 0")
        .groupBy("secret", "a", "b")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    seen = {(r.secret, r.a, r.b): r.n for r in counts}
    total = {}
    for (secret, a, _), n in seen.items():
        total[secret, a] = total.get((secret, a), 0) + n

    def logp(secret: bool, a: int, b: int) -> float:
        return log((seen.get((secret, a, b), 0) + smoothing) / (total.get((secret, a), 0) + smoothing * (_STATES - 1)))

    return SecretModel(tuple(0.0 if b == 0 else round(logp(True, a, b) - logp(False, a, b), 6) for a in range(_STATES) for b in range(_STATES)))


def generated_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled random strings of three usual kinds: hexadecimal, base 64 and capitals with digits."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.rtrim(F.base64(F.unhex(digest)), F.lit("="))
    kind = F.col("id") % 3
    token = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, base64).otherwise(F.upper(F.substring(F.conv(F.substring(digest, 1, 15), 16, 36), 1, 11)))
    return spark.range(n).select(token.alias("token"), F.lit(True).alias("secret"))


def corpus_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled tokens of ``max_docs`` documents, first by a hash of their id: what the
    patterns find is random, other tokens of eight or more characters, and identifiers put
    together from them, are ordinary."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = rows.select(F.col("id").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(max_docs)
    some = rows.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("chosen")), "left_semi")
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= 8)
    runs = F.concat(F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_.=-]{8,}"), F.lit(0))
    parted = some.select(values.alias("values"), runs.alias("runs"), tokens.alias("tokens"))
    ordinary = F.filter("tokens", lambda t: ~(F.array_contains("values", t) | t.rlike(ACCESS) | t.rlike(HEX)))
    joined_by = lambda by: lambda p: F.concat_ws(by, p["a"], p["b"])
    # Identifiers are also made of words: each token with another of its text, in the usual styles.
    pairs = F.filter(F.zip_with(ordinary, F.reverse(ordinary), lambda a, b: F.struct(F.lower(a).alias("a"), F.lower(b).alias("b"))), lambda p: p["a"] < p["b"])
    made = F.concat(F.transform(pairs, lambda p: F.concat(p["a"], F.initcap(p["b"]))), *[F.transform(pairs, joined_by(by)) for by in "_-/"], F.transform(pairs, lambda p: F.upper(F.concat_ws("_", p["a"], p["b"]))))
    ordinary = F.concat(ordinary, made)
    labelled = F.concat(
        F.transform(F.concat("values", "runs"), lambda t: F.struct(t.alias("token"), F.lit(True).alias("secret"))),
        F.transform(ordinary, lambda t: F.struct(t.alias("token"), F.lit(False).alias("secret"))),
    )
    return parted.select(F.inline(labelled))


def _found(text: Column, pattern: str, passes, cheap: Column | None = None) -> Column:
    """Spans (start, end, match) of the leftmost non-overlapping matches that pass, in code
    points.  Places follow from the lengths of the matches and of the pieces between them."""
    array = "array<struct<start:int,end:int,match:string>>"
    between = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda n, m: F.struct(n.alias("n"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(array).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["n"]
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))
        return F.struct(end.alias("at"), F.when(passes(x["m"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    gate = text.rlike(pattern) if cheap is None else cheap & text.rlike(pattern)
    return F.when(gate, F.aggregate(both, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(array))


def find_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", min_length: int = MIN_LENGTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, rank, end, kind, match) by start, then kind.

    Places are in code points of the whole text, ends exclusive.  A null or empty text has an
    empty array; repeated rows have equal results; nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    always = lambda m: F.lit(True)
    found = packed(docs, text_col).withColumns(
        {
            "assign": _found(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8),
            "access": _found(text, ACCESS, always, F.contains(text, F.lit("AKIA"))),
            "hex": _found(text, HEX, always),
            "token": _found(text, r"[A-Za-z0-9+/_=-]{%d,}" % min_length, lambda m: model.score(m) >= threshold),
        }
    )

    def ranked(column: str, rank: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(KINDS[rank]).alias("kind"), s["match"]))

    based = found.withColumn("base", F.concat(ranked("assign", 0), ranked("access", 1), ranked("hex", 2)))
    extra = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = based.withColumn("token", extra)
    return unpacked(added, docs, text_col, secrets=F.array_sort(F.concat("base", ranked("token", 3))))


def spans_text(secrets: Column, max_rank: int = len(KINDS) - 1) -> Column:
    """kind:start:end of spans, comma-joined."""
    some = F.filter(secrets, lambda s: s["rank"] <= max_rank)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
