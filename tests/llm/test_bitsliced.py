"""Bit-sliced top-k against plain inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingscape.llm import bitsliced

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, v string, dim string, group string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in good if i != q and len(v) == len(a))
        out |= {(q, r + 1, i, -s, a) for r, (s, i) in enumerate(scored[:k])}
    return sorted((x[0], x[1], x[2], x[3]) for x in out)


def got(df, k=10, every=100):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bitsliced.top_k(df, F.col("id") % every == 0, k=k).collect())


@pytest.mark.parametrize("dim, rows, high", [(1, 70, 1), (3, 64, 5), (4, 200, 700), (9, 129, 1), (64, 300, 600), (65, 65, 30000), (3, 100, 400_000_000)])
def test_block_equals_inner_products(dim, rows, high):
    rng = np.random.default_rng(dim)
    ids = np.sort(rng.integers(0, rows, rows))
    vectors = rng.integers(-high, high + 1, (rows, dim))
    block = bitsliced.Block(ids, vectors)
    subsets = block.subset_sums()
    for query in rng.integers(-high, high + 1, (6, dim)):
        own = int(rng.integers(0, rows))
        scores = vectors @ query
        want = sorted((-int(s), int(i)) for i, s in zip(ids, scores, strict=True) if i != own)[:10]
        assert sorted((-int(s), int(i)) for i, s in zip(*block.best(query, subsets, 10, own), strict=True)) == want
        slices = block.scores(query, subsets)
        assert (block.read(slices, np.arange(rows), query) == scores).all()


def test_sliced_addition():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 20, 130), rng.integers(0, 1 << 7, 130)
    assert (bitsliced.add(bitsliced.sliced(a[None], 20), bitsliced.sliced(b[None], 7)) == bitsliced.sliced((a + b)[None], 21)).all()


def test_whole_search(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    assert got(frame(spark, rows)) == brute(rows)


def test_several_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "QUERY_BATCH", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(np.float32).tolist()) for i in range(200)]
    assert got(frame(spark, rows), k=3, every=7) == brute(rows, 3, 7)


def test_ties_copies_and_few_rows(spark):
    same = [(i, [0.5, -0.25]) for i in range(0, 400, 10)]
    copies = same + [(5, [0.5, -0.25])] * 40 + [(100, [0.5, -0.25])] * 3
    assert got(frame(spark, copies)) == brute(copies)
    assert got(frame(spark, [(0, [1.0])])) == []
    assert got(frame(spark, [(0, [1.0]), (3, [-0.5])])) == [(0, 1, 3, -512 * 1024)]


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [None, 1.0]), (300, [math.nan, 1.0]), (400, [math.inf, 0.0]), (None, [1.0, 1.0]), (500, []), (501, []), (600, [1.0]), (7, [-0.0001, 0.0]), (8, [0.0, 0.0]), (-100, [3.0, 4.0])]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, rows).where("vec_id = 1")) == []
    # too large for a long: takes no part
    assert got(frame(spark, [(0, [1.0]), (1, [3e38]), (2, [2.0])])) == [(0, 1, 2, 1024 * 2048)]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(v), 1.0, -2.0]) for i, v in enumerate([30000, -30000, 29999, 12345, -1, 0])]
    assert got(frame(spark, rows), every=1) == brute(rows, 10, 1)
