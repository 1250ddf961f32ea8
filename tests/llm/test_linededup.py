import random

from tests.llm.helpers import documents, empty, odd_documents

from gridloom.llm import linededup


def brute(docs, size=3):
    """[(id, text)] -> {(id, text): text left}, in order of id and place; null ids last."""
    seen, gone = {}, {}
    unique = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    for k, t in unique:
        lines = (t or "").split("\n")
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if "".join(w).strip(" \t\x0b\f\r") and seen.setdefault(w, (k, t, i)) != (k, t, i):
                gone.setdefault((k, t), set()).update(range(i, i + size))
    return {d: None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone.get(d, ())) for d in unique}


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    lines = [f"line {k}" for k in range(6)] + ["", " ", "\t"]
    docs = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 14)))) for k in range(150)]
    want = brute(docs)
    out = linededup.dedup_lines(documents(spark, docs).withColumnRenamed("lang", "gone")).collect()
    assert {r.doc_id: r.text for r in out} == {k: v for (k, _), v in want.items()}


def test_passages(spark):
    p = "one of it\ntwo of it\nthree of it\nfour of it"
    docs = [(1, f"start\n{p}\nend"), (2, f"{p}\nother"), (3, "one of it\ntwo of it\nsomething else"), (4, f"x\n{p}\ny\n{p}")]
    got = {r.doc_id: (r.text, r.lines_removed) for r in linededup.dedup_lines(documents(spark, docs)).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("other", 4), 3: (docs[2][1], 0), 4: ("x\ny", 8)}


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == {k: v for (k, _), v in want.items()} and any(v != t for (_, t), v in want.items())


def test_odd_rows(spark):
    odd = odd_documents(spark)
    out = linededup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "lines_removed"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 2] == ["before\nafter"] * 2
    assert [r.text for r in rows if r.doc_id == 3] == [None] and [r.text for r in rows if r.doc_id == 4] == [""]
    assert linededup.dedup_lines(empty(spark)).count() == 0
