from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "hash", "id", "gone", "count", "copy", "rate", "told", "_id", "_h", "found", "base", "assign", "text_hash", "fp", "marks", "spans", "n", "kind"]


def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names
    operators use themselves."""
    passage = "one line of the passage\nanother line of it\nand a third line"
    rows = [
        (1, passage, "en", "a", 1),
        (2, "before\n" + passage + "\nafter", "en", None, 1),
        (2, "before\n" + passage + "\nafter", "en", None, 1),
        (3, None, None, "a", None),
        (4, "", "en", "b", 0),
        (None, "a text without an id " * 3, None, None, None),
        (None, None, None, None, None),
        (5, "word " * 60_000, "en", "a", 300_000),
        (6, "x" * 200_000, "en", "a", 200_000),
        (7, "   \n\t \n  \n", "en", "c", 9),
        (8, "1234 5678 !!", "en", "c", 12),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(nodes, pairs):
    """Smallest node reachable, by union-find."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    low = {}
    for n in nodes:
        low[root(n)] = min(low.get(root(n), n), n)
    return {n: low[root(n)] for n in nodes}
