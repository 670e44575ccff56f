"""Exact top-k search and exact clustering against brute force in whole numbers, with odd and huge vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import centroids, columnar


def clustered(n, dim, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("id", "v", "d", "bar", "block", "part", "cells")})


def top(rows, k=5, scale=256, every=50):
    """Brute force over distinct (id, vector) rows, in Python's integers."""
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    asks: dict = {}
    for i, v in fine:
        if i % every == 0:
            asks.setdefault(i, v)
    whole = lambda v: [int(np.floor(x * scale)) for x in v]
    out = []
    for q, v in asks.items():
        held = lambda s: max(-(2**63), min(2**63 - 1, s))
        score = sorted((-held(sum(a * b for a, b in zip(whole(v), whole(w), strict=True))), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in columnar.search(df, lambda i: i % 50 == 0).collect())


@pytest.mark.parametrize("block, asks, seeds, reach", [(columnar.BLOCK, columnar.ASKS, columnar.SEEDS, columnar.REACH), (100, 4, 16, 65_536), (70, 3, 1, 0)])
def test_top_k_is_exact(spark, monkeypatch, block, asks, seeds, reach):
    for name, value in (("BLOCK", block), ("ASKS", asks), ("SEEDS", seeds), ("REACH", reach)):
        monkeypatch.setattr(columnar, name, value)
    x = clustered(700, 40)
    x[200:] *= np.linspace(0.01, 2, 500)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(x, 2))]
    assert found(table(spark, rows)) == top(rows)


def test_bounds_drop_most_of_the_work():
    """Clustered vectors, mass falling over dimensions: of all cells of the matrix a third at most is added up."""
    x = np.floor(256 * clustered(4000, 64) * np.linspace(3, 0.2, 64))
    q = x[:40]
    block = columnar.Slabs(x, np.argsort(-(x**2).sum(axis=0)))
    done = list(columnar.best(block, q, np.full(40, -np.inf), [np.array([i]) for i in range(40)], 5))
    assert sum(cells for _, _, _, cells in done) < 40 * x.size / 3
    for j, at, score, _ in done:
        s = x @ q[j]
        s[j] = -np.inf
        assert at.tolist() == np.lexsort((np.arange(4000), -s))[:5].tolist() and score.tolist() == s[at].tolist()


def test_odd_vectors_of_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(120)]
    rows += [(0, [9.0, 9.0, 9.0]), rows[7], rows[50], (7, [5.0, 5.0, 5.0]), (200, None), (201, [1.0, None, 1.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf")] * 3), (None, [9.0] * 3), (250, []), (251, []), (300, [1.0]), (350, [1e30, 1.0, -1e30]), (351, [1e30, 2.0, -1e29]), (400, [1e308, 1.0, 1.0])]
    want = top([r for r in rows if r[0] != 400])
    assert found(table(spark, rows)) == want and {250, 350} <= {r[0] for r in want}
    assert found(table(spark, [])) == [] and found(table(spark, rows[1:40])) == []
    assert columnar.search(table(spark, []), lambda i: i % 50 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_copies_of_one_vector(spark, monkeypatch):
    """A third of all rows are one vector, and many are one row."""
    monkeypatch.setattr(columnar, "BLOCK", 64)
    rows = [(i, [1.0, 0.5] if i % 3 else [float(i % 7), 1.0]) for i in range(300)] + [(11, [4.0, 4.0])] * 200
    assert found(table(spark, rows)) == top(rows)


def lloyd(rows, k=16, rounds=3, dim=64, scale=64):
    own = [(i, [int(np.floor(x * scale)) for x in v], tuple(v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [r[1] for r in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, one, strict=True)), j) for j, one in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x, _ in own]
        c = [[sum(v) // len(g) for v in zip(*g, strict=True)] if (g := [x for (_, x, _), j in zip(own, at, strict=True) if j == i]) else c[i] for i in range(len(c))]
    last, most = [near(x) for _, x, _ in own], 2**63 - 1
    within = [sum(d for d, j in last if j == i) for i in range(len(c))]
    return [(i, j, min(d, most), min(within[j], most), min(sum(within), most), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _, _), (d, j) in zip(own, last, strict=True)]


def clusters(spark, rows, **how):
    return sorted(map(str, (tuple(r) for r in centroids.clusters(table(spark, rows), **how).collect())))


@pytest.mark.parametrize("block, step", [(centroids.BLOCK, centroids.STEP), (7, 3)])
def test_clusters_are_exact(spark, monkeypatch, block, step):
    monkeypatch.setattr(centroids, "BLOCK", block)
    monkeypatch.setattr(centroids, "STEP", step)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(300, 64, 5, 0.4))]
    assert clusters(spark, rows) == sorted(map(str, lloyd(rows)))


def test_odd_vectors_of_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.normal(size=64), 1).tolist()) for i in range(20)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (30, None), (31, [1.0] * 63), (32, [None] + [1.0] * 63), (33, [float("nan")] * 64), (34, [1e10] + [0.0] * 63), (35, [-1e30] * 64), (36, [1e308] * 64)]
    assert clusters(spark, rows) == sorted(map(str, lloyd([r for r in rows if r[0] != 36])))
    few = [(i, [float(i)] * 64) for i in range(5)] + [(9, [0.0] * 64)]
    assert clusters(spark, few) == sorted(map(str, lloyd(few)))
    assert clusters(spark, []) == []
