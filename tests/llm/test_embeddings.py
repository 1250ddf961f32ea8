import numpy as np
import pytest
from tests.llm.helpers import components

from gridloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, id string, kind string"


def planted(seed=3, clusters=25, each=6, dim=48):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(each):
            noise = rng.standard_normal(dim)
            noise /= np.linalg.norm(noise)
            rows.append(((centre + noise * rng.uniform(0.05, 0.6)) * rng.uniform(0.1, 9), c % 3))
    return [(k, [float(x) for x in np.float32(v)], label, "x", "y") for k, (v, label) in enumerate(rows)]


def brute(rows, cosine=0.93):
    links, ok = {r[0]: set() for r in rows}, {}
    for k, v, label, *_ in rows:
        x = np.array([np.nan if e is None else e for e in v], float) if v is not None else None
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[k] = (label, x / np.linalg.norm(x))
    for a, (la, x) in ok.items():
        for b, (lb, y) in ok.items():
            if a < b and la == lb and len(x) == len(y) and x @ y >= cosine:
                links[a].add(b)
                links[b].add(a)
    part = components(list(links), [(a, b) for a in links for b in links[a]])
    return {k: (len(links[k]), part[k], part[k] == k) for k in links}


@pytest.mark.parametrize("block", [2048, 4])
def test_equals_brute_force(spark, block):
    rows = planted()
    n = len(rows)
    rows += [(n + k, rows[0][1], rows[0][2], "x", "y") for k in range(20)]  # exact copies
    rows += [(n + 20, None, 1, "", ""), (n + 21, [0.0] * 48, 1, "", ""), (n + 22, [float("nan")] + [1.0] * 47, 1, "", ""), (n + 23, [None] + [1.0] * 47, 1, "", "")]
    rows += [(n + 24, rows[0][1], None, "", ""), (n + 25, [1.0, 0.0], 0, "", ""), (n + 26, [2.0, 0.1], 0, "", ""), (n + 27, [], 0, "", ""), (n + 28, [float("inf"), 1.0], 0, "", "")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [2, 3, 4, 8])
def test_blocks_count_each_pair_once(spark, block):
    """Twenty seeds, each with labels of its own; small blocks leave some of a pair empty."""
    rows = []
    for seed in range(20, 40):
        rows += [(len(rows) + k, v, 3 * seed + label, "x", "y") for k, v, label, *_ in planted(seed=seed, clusters=40, each=5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    want = {}
    for at in range(0, len(rows), 200):  # the rows of a seed
        want |= brute(rows[at : at + 200])
    assert got == want


def test_repeated_ids_are_further_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (2, [0.0, 1.0], 1, "", "")]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_empty_and_null_ids(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0, 2.0], 1, "", ""), (None, [1.0, 2.0], 1, "", ""), (None, None, 1, "", "")]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_links for r in got) == [0, 1, 1] and all(r.component_id is None for r in got)


def test_decoding_lists_every_exceeding_direction():
    codes = embeddings.ProductCodes(rotations=2, blocks=3, words=5, margin=0.5)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 26))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, code = codes.tables(26)
    row, name = codes.decode(x)
    padded = np.zeros((40, 27))
    padded[:, :26] = x
    want = set()
    for r in range(2):
        y = padded @ turn[r]
        for i in range(40):
            s = [y[i, b * 9 : b * 9 + 9] @ code[r, b].T / np.sqrt(3) for b in range(3)]
            total = (s[0][:, None, None] + s[1][None, :, None] + s[2][None, None, :]).ravel()
            want |= {(i, r * 125 + int(k)) for k in np.flatnonzero(total >= total.max() - 0.5 / np.sqrt(27) - 1e-12)}
    assert set(zip(row.tolist(), name.tolist())) == want


@pytest.mark.parametrize("rows", [1000, 1_000_000, 10_000_000, 1_000_000_000])
def test_recall_at_the_threshold(rows):
    rng = np.random.default_rng(5)
    u = rng.standard_normal((1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = rng.standard_normal(u.shape)
    n -= (n * u).sum(axis=1, keepdims=True) * u
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * n
    a, b = (set(zip(*(x.tolist() for x in embeddings.ProductCodes.for_rows(rows).decode(w)))) for w in (u, v))
    assert len({i for i, _ in a & b}) >= 0.998 * 1500


def test_codes_are_the_same_for_any_number_of_rows():
    assert len({embeddings.ProductCodes.for_rows(n) for n in (0, 200_000, 200_001, 2_000_001, 100_000_001)}) == 1


@pytest.mark.parametrize("dim", [2, 7, 16, 64, 129])
def test_recall_of_the_one_code(dim):
    rng = np.random.default_rng(dim)
    u, w = rng.standard_normal((2, 3000, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    a, b = (set(zip(*(x.tolist() for x in embeddings.ProductCodes().decode(y)))) for y in (u, 0.93 * u + np.sqrt(1 - 0.93**2) * w))
    assert len({i for i, _ in a & b}) >= 0.999 * 3000


@pytest.mark.parametrize("block", [2048, 150, 64])
def test_long_runs_equal_brute_force(spark, block):
    rows = planted(seed=8, clusters=100)  # 200 vectors of a label, all under the same directions
    codes = embeddings.ProductCodes(rotations=1, blocks=2, words=2, margin=100.0)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA), codes=codes, block=block).collect()}
    assert got == brute(rows)
