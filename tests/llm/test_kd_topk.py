"""Exact top-k against a full sort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.llm.kd_topk import Tree, search, top_k


def brute(rows, k, scale=64):
    v = {i: [math.floor(scale * float(x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in (i for i in v if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(8192, 8192), (60, 7)])
def test_equals_full_sort(spark, shard, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 0.3]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)]  # one very common vector
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, [0.5]), (2100, [0.25]), (None, [0.1] * 6), (2120, [1e7] * 6), (2140, []), (2160, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard, block_rows=block).collect())
    rows = [(i, e if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    assert got == brute(rows, 20)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (8, 4))
    x = centres[rng.integers(8, size=3000)] + rng.integers(-3, 4, (3000, 4))
    tree = Tree(x)
    q = x[:5]
    bound = tree.bounds(q)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert ((q @ x[rows].T).max(axis=1) <= bound[:, node]).all()
    score, row = search(tree, np.arange(3000), q, np.full(5, -(1 << 62)), 3)
    full = np.lexsort((np.broadcast_to(np.arange(3000), (5, 3000)), -(q @ x.T)), axis=1)[:, :3]
    assert (row == full).all()
