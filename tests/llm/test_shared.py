import random

from tests.llm.helpers import components

from gridloom.llm.shared import connected_components


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(80)] + [(5, 5), (7, 3), (3, 7)]
    df = spark.createDataFrame([*pairs, (None, 4)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    want = components(sorted({x for p in real for x in p}), real)
    assert got == {node: root for node, root in want.items() if node != root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
