"""Hard negatives against all inner products, with nulls, ties, repeats, clashes and many blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, q string, cell long, v string"


def _brute(rows, positives=5, negatives=3):
    points = {}
    for i, x, y, *_ in rows:
        if i is not None and x is not None and y is not None and all(c is not None and math.isfinite(c) for c in x):
            points[i, y, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    dot = lambda a, b: sum(s * t for s, t in zip(a, b))
    out = []
    for i, y, x in points:
        if i % 50 == 0:
            scored = sorted(((-dot(x, z), j, k) for j, k, z in points if j != i), key=lambda r: r[:2])
            for s, j, _ in [r for r in scored if r[2] == y][:positives]:
                fits = [r for r in scored if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
                out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits)]
    return sorted(out)


def _mine(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hn.hard_negatives(df, anchors=F.col("vec_id") % 50 == 0).collect())


def _rows(n, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 8)) * 0.3
    rows = [(i, [float(c) for c in x[i]], int(rng.integers(0, 3)), "q", 1, "v") for i in range(n)]
    bad = [(n, None, 1), (n + 1, [1.0, None, 2.0], 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [float("inf")] * 8, 1), (n + 4, [1.0] * 8, None), (None, [1.0] * 8, 1),
           (n + 5, [], 2), (n + 6, [0.0] * 8, 0), (n + 7, [2.0, 1.0], 2)]
    ties = [(1000 + i, rows[3][1], i % 2) for i in range(120)]
    return [*rows, *((*r, "q", 1, "v") for r in (*bad, *ties)), rows[0], rows[5], (50, rows[9][1], 1, "q", 1, "v")]


@pytest.mark.parametrize(("block", "leaf", "clusters"), [(4096, 128, 4), (60, 8, 6), (40, 4, 1)])
def test_equals_all_products(spark, monkeypatch, block, leaf, clusters):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "LEAF", leaf)
    monkeypatch.setattr(hn, "SLICE", 5)
    rows = _rows(400, clusters, leaf)
    want = _brute(rows)
    assert len(want) > 50 and _mine(spark, rows) == want


def test_few_rows_and_large_components(spark):
    some = lambda *rows: [(*r, "q", 1, "v") for r in rows]
    assert _mine(spark, []) == [] and _mine(spark, some((50, [1.0], 1))) == [] and _mine(spark, some((50, None, None))) == []
    assert _mine(spark, some((50, [1.0], 1), (51, [1.0], 1), (52, [0.5], 1))) == []
    big = some((50, [2.0**20, 3.0], 1), (51, [2.0**20, 2.0**19 + 1], 1), (52, [2.0**19, 2.0**18 + 1], 2), (53, [2.0**19, 5.0], 2), (54, [2.0**24] * 2, 3))
    assert _mine(spark, big) == _brute(big) != []


def test_radii_bound_all_products():
    rng = np.random.default_rng(4)
    points = np.floor(rng.normal(size=(900, 6)) * 40)
    tree = hn.CoverTree(np.arange(900), np.zeros(900, int), points, float((points ** 2).sum(1).max()))
    q = np.floor(rng.normal(size=(7, 6)) * 40)
    low, high = tree.bounds(q)
    assert sorted(tree.ids.tolist()) == list(range(900)) and (tree.radius[1:] <= 2 * tree.radius[tree.parent[1:]] + 1e-6).all()
    below = {}
    for node in range(len(tree.parent) - 1, -1, -1):
        at, n = tree.heads[node]
        below[node] = [r for r in range(at, at + n)] if at >= 0 else [r for c in np.flatnonzero(tree.parent == node) for r in below[c]]
        s = q @ tree.points[below[node]].T
        assert (s >= low[:, node, None]).all() and (s <= high[:, node, None]).all()
    best = hn.search_same(tree, q, np.zeros(7, int), np.full(7, -np.inf), 4)
    assert (best.score == -np.sort(-(q @ points.T), axis=1)[:, :4]).all()
