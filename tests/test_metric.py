"""Neighbours through pivots against all pairs, and how few blocks are compared."""

from __future__ import annotations

import numpy as np
import pytest

from loopwright.operators import metric as M
from loopwright.operators import retrieval as T

SHAPE = "vec_id long, embedding array<double>"


def bunches(n=600, dim=8, seed=1, wide=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    x = middle[rng.integers(6, size=n)] + rng.normal(size=(n, dim)) * wide
    x[:5] = 0  # zero vectors
    x[5:60] = x[60]  # copies
    return x


def frame(spark, x):
    rows = [(int(i), x[i].tolist()) for i in range(len(x))]
    return spark.createDataFrame([*rows, (None, x[-1].tolist()), (10_000, None)], SHAPE).repartition(4)


def plain(x, k, queries=None):
    s = np.floor(M.cosines(x if queries is None else x[queries], x) * 1e9 + 0.5)
    out = {}
    for r, q in enumerate(range(len(x)) if queries is None else queries):
        order = [i for i in np.lexsort((np.arange(len(x)), -s[r])) if i != q][:k]
        out[int(q)] = [int(i) for i in order]
    return out


@pytest.mark.parametrize("rows", [64, 5000])
def test_top_k_is_that_of_all_pairs(spark, rows):
    x = bunches()
    got = {}
    for r in T.cosine_topk(None, frame(spark, x), 7, block_rows=rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item)
    assert got == plain(x, 7)
    some = [0, 3, 20, 61, 300, 599]
    asked = frame(spark, x).where("vec_id in (0, 3, 20, 61, 300, 599)").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in T.cosine_topk(asked, frame(spark, x), 4, block_rows=rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item)
    assert got == plain(x, 4, some)


def test_every_pair_over_the_threshold_is_found(spark):
    x = bunches(300)
    d = frame(spark, x).withColumnRenamed("vec_id", "id")
    s = M.cosines(x, x)
    lead = {i: min(j for j in range(len(x)) if (x[j] == x[i]).all()) for i in range(len(x))}
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if lead[a] == a and lead[b] == b and s[a, b] >= 0.97}
    want |= {(lead[i], i) for i in range(5, len(x)) if lead[i] != i}
    for rows in (32, 5000):
        got = M.within(d, 0.97, rows).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    # two bunches of twelve, close to each other: no vector loses a link for having many
    rng = np.random.default_rng(2)
    y = np.concatenate([c + rng.normal(size=(12, 64)) * 0.01 for c in (np.ones(64), np.ones(64) + np.eye(64)[0] * 2)])
    assert M.within(frame(spark, y).withColumnRenamed("vec_id", "id"), 0.9).count() == 24 * 23 // 2
    assert M.within(frame(spark, y).withColumnRenamed("vec_id", "id").limit(0), 0.9).count() == 0


def test_far_blocks_are_not_compared(spark):
    x = bunches(4000, 16, wide=0.02)
    d = frame(spark, x).withColumnRenamed("vec_id", "id")
    index = M.Index(d, 100)
    blocks = index.blocks.count()
    pairs = M.block_pairs(index, index, 0.1).count()
    assert blocks >= 30 and pairs <= blocks * blocks / 4
    sizes = [r["count"] for r in index.placed.groupBy("block").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 600
    rows = [r for r in index.blocks.where("cell >= 0").collect()]
    angles = np.arccos(np.clip(M.cosines(x, index.pivots), -1, 1))
    held = {r.id: r.block for r in index.placed.collect()}
    for r in rows:  # the ranges hold every vector of the block
        own = angles[[i for i, b in held.items() if b == r.block]]
        assert (own.min(axis=0) >= np.array(r.low) - 1e-9).all() and (own.max(axis=0) <= np.array(r.high) + 1e-9).all()


def test_zero_vectors_alone(spark):
    x = np.zeros((50, 4))
    got = T.cosine_topk(None, frame(spark, x[:49]), 2, block_rows=8)
    assert {(r.query_id, r.item, r.sim) for r in got.where("query_id in (0, 5)").collect()} == {(0, 1, 0.0), (0, 2, 0.0), (5, 0, 0.0), (5, 1, 0.0)}


def test_neighbours_within_a_tile(spark):
    """Ties, copies, zero and huge vectors: what the screening in single precision lets through is what a full sort gives."""
    from loopwright.operators.metric import nearest_of, tile_rows

    rng = np.random.default_rng(5)
    y = rng.normal(size=(700, 6)).astype(np.float32).astype(float)
    y[100:300] = y[7]
    y[300:340] = 0
    y[340:380] = y[340] * np.arange(1, 41)[:, None]
    y[400] = 1e200
    b = np.sort(rng.choice(5000, 700, replace=False))
    x, a = y[::3], b[::3]
    for k in (1, 5, 60, 2000):
        got = {}
        for q, i, s in zip(*nearest_of(a, x, b, y, k, rows=50, cols=64), strict=True):
            got.setdefault(int(q), []).append((-np.floor(s * 1e9 + 0.5), int(i)))
        for q, v in zip(a.tolist(), x, strict=True):
            n = np.linalg.norm(y, axis=1) * np.linalg.norm(v)
            s = np.divide(y @ v, n, out=np.zeros(len(y)), where=n > 0)
            want = sorted((-np.floor(z * 1e9 + 0.5), int(i)) for z, i in zip(s, b, strict=True) if i != q)[:k]
            assert sorted(got[q]) == want, (k, q)
    # as many tiles for a large table as for a small one, so rows are not sent to ever more of them
    assert [-(-n // tile_rows(n)) for n in (2000, 40_000, 600_000)] == [1, 16, 16]
