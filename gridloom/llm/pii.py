"""Surrogates for personal data.  DataFrame functions only.

Detected entities are replaced by keyed surrogates of the same type and format.  One entity
has one surrogate wherever it occurs, in whatever format (coreference), and no two entities
share one (distinctness):

* Numbers (phones, cards, social security numbers, IP addresses, account numbers) go through a
  keyed permutation of their own format, a Feistel network over their digits, so they are
  distinct by construction.  Country codes, first digits and networks stay, and check digits
  hold.  A permutation may give one number the value that another number had.
* Names and e-mail addresses have no bounded format.  Their candidates are hashed with the key
  and an attempt number; those that coincide with each other or with a value that really
  occurs try again, each time in a much larger space, until none is left.

Names are found behind a title; after that every mention of the name's words in the document
counts, with or without a title, capitalised or in capitals.  Names that never have a title in
their document are not found.  All keyed hashes are HMAC-SHA-256.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import packed, unpacked, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Titles by the gender they tell, words within names, and calling codes.
TITLES = {
    "m": "Mr|Herr|Señor|Sr|Monsieur|Signor|г-н|господин|Κύριος",
    "f": "Mrs|Ms|Miss|Frau|Fräulein|Señora|Sra|Srta|Madame|Mme|Mademoiselle|Mlle|Signora|г-жа|госпожа|Κυρία",
    "u": "Dr|Prof",
}
PARTICLES = "van|von|de|der|den|del|della|di|da|dos|la|le|du|al|bin|ibn|zu"
CALLING_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_ANY_TITLE = "|".join(TITLES.values())
_CASED = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]++)*+)"
#: A title and the words of a name behind it: capitalised words, initials and particles, or one
#: word of a script without capitals.
TITLED_NAME = rf"(?=[MHSFDPгΚ])(?<!\w)({_ANY_TITLE})\.? ({_CASED}(?: ?(?:(?:{PARTICLES}) )*{_CASED})*|\p{{Lo}}[\p{{Lo}}\p{{M}}]*+)"
#: What finds each other type.  Each starts by a look at one character, so that most places cost little.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ipv6": r"(?=[\dA-Fa-f:])(?<![\w:.])(?:(?:[\dA-Fa-f]{1,4}:){7}[\dA-Fa-f]{1,4}|(?=(?:[\dA-Fa-f]{0,4}:){2,7}[\dA-Fa-f]{0,4}(?![\w:]))(?:[\dA-Fa-f]{1,4}(?::[\dA-Fa-f]{1,4}){0,5})::(?:[\dA-Fa-f]{1,4}(?::[\dA-Fa-f]{1,4}){0,5})?|::[\dA-Fa-f]{1,4}(?::[\dA-Fa-f]{1,4}){0,6})(?![\w:]|\.\d)",
    "iban": r"(?=[A-Z])(?<![\w])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "phone": r"(?=\+)(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?=[(\d])(?<![\w+])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d)",
    "card": r"(?=\d)(?<![\w])(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4})(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
}
NUMBERS = ("phone", "card", "ssn", "ip", "ipv6", "iban")
_ALL = "|".join(PATTERNS.values())
#: Texts without any of these hold no entity: an @, seven or more characters of numbers and their
#: punctuation, two colons among hexadecimal digits, two capitals before two digits, or a title
#: before a name.
_DIGITS, _COLONS, _ACCOUNT, _TITLED = r"[+(\d][\d() .-]{5,}\d", r"[\dA-Fa-f]:[\dA-Fa-f]{0,4}:|::[\dA-Fa-f]", r"(?<!\w)[A-Z]{2}\d{2}[ A-Z0-9]", rf"(?=[MHSFDPгΚ])(?:{_ANY_TITLE})\.? [\p{{Lu}}\p{{Lo}}]"

_LATIN = "ba be bi bo bu da de di do du fa fe fi fo ga ge gi go gu ha he hi ho ja jo ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu".split()
_CYRILLIC = "ба бе ви во га ге да де ди до за зи ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то".split()
_GREEK = "βα βε γα γο δα δε δι δο ζα ζη θα θε θο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split()
#: Syllables of each script and endings by gender; scripts without capitals have letters only.
SCRIPTS = {
    "Cyrillic": (_CYRILLIC, {"m": "лав", "f": "ина", "u": "ко"}),
    "Greek": (_GREEK, {"m": "ράς", "f": "ίνη", "u": "κου"}),
    "Hebrew": (list("אבגדהזחטילמנסעפקרשת"), {}),
    "Arabic": (list("ابتجحدرسصطعفقكلمنهوي"), {}),
    "Devanagari": (list("कखगचजटडतदनपबमयरलवसह"), {}),
    "Han": (list("安白成大东方光海和华江金立林明南平清山石天文西新阳永玉元云正中子"), {}),
    "Hiragana": (list("あいうえかきくけこさしすたちつてとなにのはひふほまみもやゆよらりるれろわ"), {}),
    "Katakana": (list("アイウエカキクケコサシスタチツテトナニノハヒフホマミモヤユヨラリルレロワ"), {}),
    "Hangul": (list("가강경고구근기나남다도동라려로마명미민바보부사상서성세소수승시아안영예오우원유은이인재정조주준지진창철하한해현호홍"), {}),
}
_SPANS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def may_hold_entities(text: Column) -> Column:
    """A cheap test that every text with an entity passes."""
    return F.contains(text, F.lit("@")) | text.rlike(_DIGITS) | text.rlike(_COLONS) | text.rlike(_ACCOUNT) | text.rlike(_TITLED)


def entity_type(match: Column) -> Column:
    """The type of a match; what has no other type is a name.  Null for what looks like an
    account number but has wrong check digits, and for 13 to 19 digits with a wrong check digit
    that do not have the 16 digits of nearly every card: times, books and serial numbers."""
    out = F.lit("name")
    for kind in ("phone", "card", "ssn", "ipv6", "ip"):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    digits = F.regexp_replace(match, r"\D", "")
    n = F.length(digits)
    checked = (_luhn_sum(F.substring(digits, F.lit(1), n - 1)) + F.substring(digits, n, F.lit(1)).cast("int")) % 10 == 0
    out = F.when((out == "card") & (n != 16), F.when(checked, "card")).otherwise(out)
    account = match.rlike(f"^(?:{PATTERNS['iban']})$")
    return F.when(F.contains(match, F.lit("@")), "email").when(account, F.when(_mod_97(F.regexp_replace(match, " ", "")) == 1, "iban")).otherwise(out)


def _mod_97(account: Column) -> Column:
    """The remainder of an account number as its check digits see it."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97)


def _full_ipv6(value: Column) -> Column:
    """All eight groups, lower case, four digits each, without colons."""
    left, right = (F.filter(F.split(F.substring_index(F.lower(value), "::", k), ":"), lambda g: g != "") for k in (1, -1))
    whole = ~F.contains(value, F.lit("::"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    groups = F.when(whole, left).otherwise(F.concat(left, zeros, right))
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common: digits only, with the country code of North
    America where a phone has none; groups written out; or lower case."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind == "phone", F.when(value.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "ip", F.regexp_replace(value, r"(?<!\d)0+(?=\d)", ""))
        .when(kind == "ipv6", _full_ipv6(value))
        .otherwise(F.lower(value))
    )


def _hmac(key: str, *message: Column) -> Column:
    """HMAC-SHA-256 of the parts of a message, one on a line, in hexadecimal."""
    from hashlib import sha256

    raw = key.encode()
    raw = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in raw)) for x in (0x36, 0x5C))
    text = F.encode(F.concat_ws("\n", *[m.cast("string") for m in message]), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)


def permuted(key: str, tweak: Column, digits: Column, base: int = 10) -> Column:
    """A keyed permutation of the strings of as many digits, decimal or hexadecimal, up to 28;
    one for each tweak.  Six rounds of a Feistel network whose halves are numbers."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(float(base)), k).cast("long")  # noqa: E731  exact up to 56 bits
    number = lambda s: F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0).cast("long"))
    begin = F.struct(number(F.substring(digits, F.lit(1), u)).alias("a"), number(F.substring(digits, u + 1, n)).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        move = F.conv(F.substring(_hmac(key, tweak, n, r, F.when(even, acc["b"]).otherwise(acc["a"])), 1, 14), 16, 10).cast("long")
        a = F.when(even, (acc["a"] + move % size(u)) % size(u)).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise((acc["b"] + move % size(n - u)) % size(n - u))
        return F.struct(a.alias("a"), b.alias("b"))

    def out(acc: Column) -> Column:
        text = lambda x, k: F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, "0")
        return F.concat(F.when(u > 0, text(acc["a"], u)).otherwise(""), text(acc["b"], n - u))

    return F.aggregate(F.sequence(F.lit(0), F.lit(5)), begin, step, out)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that a check digit follows."""
    places = F.reverse(F.split(digits, ""))
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def number_surrogate(key: str, kind: Column, canon: Column) -> Column:
    """The surrogate of a canonical number: a permutation within its kind, length and prefix."""
    n = F.length(canon)

    def rest(at: Column | int) -> Column:
        return F.substring(canon, at if isinstance(at, Column) else F.lit(at), n)

    code = F.regexp_extract(canon, CALLING_CODE, 0)
    phone = F.concat(code, permuted(key, F.concat_ws(":", kind, code), rest(F.length(code) + 1)))
    # The first digit of a card stays, and by how much its check digit is wrong, if it is.
    first, body, check = F.substring(canon, 1, 1), F.substring(canon, F.lit(2), n - 2), F.substring(canon, n, F.lit(1)).cast("int")
    moved = F.concat(first, permuted(key, F.concat_ws(":", kind, first), body))
    wrong = (check + _luhn_sum(F.concat(first, body))) % 10
    card = F.concat(moved, ((20 + wrong - _luhn_sum(moved) % 10) % 10).cast("string"))
    octets = F.transform(F.split(canon, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0"))
    low = permuted(key, F.concat_ws(":", kind, F.get(octets, 0)), F.array_join(F.slice(octets, 2, 3), ""), 16)
    ip = F.concat_ws(".", F.split(canon, r"\.")[0], *[F.conv(F.substring(low, k, 2), 16, 10) for k in (1, 3, 5)])
    net = F.substring(canon, 1, 4)
    groups = F.concat(net, permuted(key, F.concat_ws(":", kind, net), rest(5), 16))
    ipv6 = F.concat_ws(":", *[F.substring(groups, k, 4) for k in range(1, 32, 4)])
    # Letters of an account stay in place; the check digits follow.
    shape = F.concat(F.substring(canon, 1, 2), F.regexp_replace(rest(5), r"\d", "0"))
    inner = _spread(rest(5), permuted(key, F.concat_ws(":", kind, shape), F.regexp_replace(rest(5), r"\D", "")))
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod_97(F.concat(country, F.lit("00"), inner))).cast("string"), 2, "0"), inner)
    return F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", permuted(key, kind, canon)).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "iban", iban)


def candidate(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of a canonical e-mail address or name at an attempt; later ones are longer."""
    d = _hmac(key, kind, canon, attempt)
    more = F.concat(d, F.sha2(d, 256))
    digits, letters = F.translate(more, "abcdef", "031425"), F.translate(more, "0123456789abcdef", "ghijkmnpqrabcdef")
    # E-mail: the local part letter for letter, then a host under a reserved domain.
    local = F.substring_index(canon, "@", 1)
    shaped = F.array_join(
        F.transform(
            F.split(local, ""),
            lambda c, i: F.when(c.rlike("[a-z]"), F.substring(letters, i % 128 + 1, F.lit(1))).when(c.rlike("[0-9]"), F.substring(digits, i % 128 + 1, F.lit(1))).otherwise(c),
        ),
        "",
    )
    host = F.substring(F.translate(F.sha2(more, 256), "0123456789", "ghijklmnop"), F.lit(1), 8 + 8 * attempt)
    email = F.concat(shaped, F.lit("@"), host, F.lit(".example.net"))

    def name(syllables: list[str], endings: dict[str, str]) -> Column:
        words = F.array(*[F.lit(s) for s in syllables])
        parts = F.transform(F.sequence(F.lit(0), attempt * 2 + (3 if endings else 1)), lambda k: F.get(words, F.pmod(F.conv(F.substring(more, k * 4 % 124 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(len(syllables)))))
        ending = F.when(gender == "m", endings["m"]).when(gender == "f", endings["f"]).otherwise(endings["u"]) if endings else F.lit("")
        return F.concat(F.array_join(parts, ""), ending)

    names = name(_LATIN, {"m": "ron", "f": "lia", "u": "ney"})
    for script, (syllables, endings) in SCRIPTS.items():
        names = F.when(canon.rlike(rf"\p{{Is{script}}}"), name(syllables, endings)).otherwise(names)
    return F.when(kind == "email", email).otherwise(names)


def _spread(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, from the left, by ``digits``."""
    return F.aggregate(
        F.split(value, ""),
        F.struct(F.lit(1).alias("k"), F.lit("").alias("out")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["k"] + 1).alias("k"), F.concat(acc["out"], F.substring(digits, acc["k"], F.lit(1))).alias("out"))).otherwise(
            F.struct(acc["k"].alias("k"), F.concat(acc["out"], c).alias("out"))
        ),
        lambda acc: acc["out"],
    )


def laid_out(kind: Column, value: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the format of the value it replaces."""
    count_ = F.length(F.regexp_replace(value, r"\D", ""))
    last = F.substring(surrogate, F.length(surrogate) - count_ + 1, count_)  # a phone may lack its country code
    grouped = F.when(F.contains(value, F.lit(" ")), F.rtrim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    cased = F.when((value == F.upper(value)) & (value != F.lower(value)) & ((kind != "name") | (F.length(value) > 1)), F.upper(surrogate)).when(kind == "name", F.initcap(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), _spread(value, last)).when(kind == "iban", grouped).otherwise(cased)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canon, surrogate) for e-mail addresses and names: the distinct (kind, canon)
    of ``entities`` with their ``gender``.

    Of candidates that coincide the one with the smallest canonical value wins; a candidate
    that is itself a value in the data, or was given out before, is refused.  The rest, a
    small share, try again with the next attempt until none is left: each attempt has over
    4,000 times as many names and 65,536 times as many hosts as the one before.
    """
    real = written(entities.groupBy("kind", "canon").agg(F.max("gender").alias("gender")), "entities")
    given, pending = None, real
    for attempt in count():
        tried = pending.withColumn("surrogate", candidate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.lit(attempt)))
        tried = tried.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if given is not None:
            tried = tried.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "given")
        given = won if given is None else given.union(won)
        pending = written(pending.join(won, ["kind", "canon"], "left_anti"), "pending")
        if pending.isEmpty():
            return given


def titled_names(text: Column) -> Column:
    """Array of (word, gender), null for either, of the names behind titles in a text."""
    titles, phrases = (F.regexp_extract_all(text, F.lit(TITLED_NAME), F.lit(k)) for k in (1, 2))

    def words(title: Column, phrase: Column) -> Column:
        gender = F.when(title.isin(TITLES["m"].split("|")), "m").when(title.isin(TITLES["f"].split("|")), "f")
        cut = F.split(F.regexp_replace(phrase, r"\p{Lu}\.", " "), " ")
        named = F.filter(cut, lambda w: (F.length(w) > F.when(w.rlike(r"\p{Lo}"), 0).otherwise(1)) & ~w.isin(PARTICLES.split("|") + _ANY_TITLE.split("|")))
        return F.transform(named, lambda w: F.struct(w.alias("word"), gender.alias("gender")))

    return F.array_distinct(F.flatten(F.zip_with(titles, phrases, words)))


def _pattern(names: Column) -> Column:
    """The expression for all entities of a document with these names: each word as it stands
    behind its title, capitalised, and in capitals; longer ones first."""
    forms = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n["word"], F.initcap(n["word"]), F.upper(n["word"])))))
    longest = F.transform(F.reverse(F.array_sort(F.transform(forms, lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))), lambda x: F.concat(F.lit("\\Q"), x["f"], F.lit("\\E")))
    ends = r"[\p{L}\p{M}\p{N}_]"
    return F.when(F.size(names) == 0, _ALL).otherwise(F.concat(F.lit(rf"{_ALL}|(?<!{ends})(?:"), F.array_join(longest, "|"), F.lit(rf")(?!{ends})")))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced, and ``pii`` added: an array of (kind,
    start, end, surrogate) of the replaced spans of the original, in code points.

    A name has the gender that all its titles in all documents agree on, else a neutral form.
    Names keep Latin, Cyrillic, Greek and the other ``SCRIPTS``; those in any further script
    become Latin ones.  Null texts stay null and have an empty array, texts without entities
    stay as they are and never travel, repeated rows have equal results, and an empty table
    stays empty.
    """
    rows = packed(docs, text_col)
    holds = F.coalesce(may_hold_entities(F.col("text")) & (F.col("text").rlike(_ALL) | F.col("text").rlike(TITLED_NAME)), F.lit(False))
    named = rows.where(holds).withColumn("names", titled_names(F.col("text")))
    cut = named.withColumn("pattern", _pattern(F.col("names")))
    found = cut.select("row", "text", "names", F.split("text", F.col("pattern"), -1).alias("between"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("m"))
    kinds = F.transform("m", lambda m, i: F.struct(i.alias("i"), entity_type(m).alias("kind"), m.alias("value")))
    found = written(found.select(F.monotonically_increasing_id().alias("at"), "row", "text", "names", "between", kinds.alias("found")), "found")

    mentions = written(found.select("at", F.inline("found")).where("kind is not null").withColumn("canon", canonical(F.col("kind"), F.col("value"))), "mentions")
    numbers = mentions.where(F.col("kind").isin(*NUMBERS)).withColumn("surrogate", number_surrogate(key, F.col("kind"), F.col("canon")))
    others = mentions.where(~F.col("kind").isin(*NUMBERS))
    genders = found.select(F.inline("names")).groupBy(F.lower("word").alias("canon")).agg(F.when(F.min("gender") == F.max("gender"), F.min("gender")).otherwise("u").alias("gender"))
    entities = others.select("kind", "canon").distinct().join(genders.withColumn("kind", F.lit("name")), ["kind", "canon"], "left")
    told = numbers.unionByName(others.join(surrogates(entities, key), ["kind", "canon"]))
    new = told.select("at", F.struct("i", "kind", "value", laid_out(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")).alias("e"))
    gathered = new.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.i"), F.col("e")))).alias("new"))

    def known(x: Column) -> Column:
        e = F.try_element_at("new", x["i"])
        return F.struct(x["value"].alias("value"), e["kind"].alias("kind"), e["new"].alias("new"))

    both = found.join(gathered, "at", "left").withColumn("e", F.transform("found", known))
    joined = F.array_join(F.flatten(F.zip_with("between", "e", lambda p, e: F.array(p, F.coalesce(e["new"], e["value"], F.lit(""))))), "")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["e"]["value"])
        span = F.array(F.struct(x["e"]["kind"].alias("kind"), start.alias("start"), end.alias("end"), x["e"]["new"].alias("surrogate")))
        return F.struct(end.alias("at"), F.when(x["e"]["new"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"))

    pairs = F.zip_with(F.slice("between", F.lit(1), F.size("e")), F.col("e"), lambda p, e: F.struct(p.alias("p"), e.alias("e")))
    changed = both.select("row", joined.alias("text"), F.aggregate(pairs, begin, place, lambda a: a["out"]).alias("spans"))
    rest = rows.where(~holds).withColumn("spans", F.array().cast(_SPANS))
    return unpacked(changed.unionByName(rest), docs, text_col, pii=F.col("spans"))
