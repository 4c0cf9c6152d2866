"""The threshold walk of the exact top-k search: exact on any rows, and ended by its bound where the data allow it."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import topk


def brute(values, ids, query, k):
    return sorted((-sum(int(x) * int(y) for x, y in zip(row, query)), int(i)) for row, i in zip(values, ids))[:k]


def as_pairs(found):
    return [(-s, i) for s, i in zip(found[1], found[0].tolist())]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 5), st.integers(1, 120), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([3, 1 << 20, 1 << 27, 1 << 40]))
def test_walk_is_exact(dims, n, k, seed, size):
    rng = np.random.default_rng(seed)
    values, query, ids = rng.integers(-size, size, (n, dims)), rng.integers(-size, size, dims), rng.permutation(n)
    want = brute(values, ids, query, k)
    lists = topk.Lists(values, ids)
    assert as_pairs(lists.best(query, k, first=1)) == want
    floor = -want[len(want) // 2][0]
    assert as_pairs(lists.best(query, k, floor, first=1)) == [w for w in want if -w[0] >= floor]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_no_possible_row_scores_above_the_bound(dims, seed):
    rng = np.random.default_rng(seed)
    weight, edge, square = rng.uniform(0.1, 2, dims), rng.normal(0, 1, dims), float(rng.uniform(0.1, 4))
    edge[rng.random(dims) < 0.3] = np.inf
    best = topk.highest(weight, edge, square)
    rows = rng.normal(0, 1, (500, dims))
    rows *= np.sqrt(square) * rng.random((500, 1)) / np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.minimum(rows, edge)
    rows = rows[(rows**2).sum(1) <= square]
    if best is None:
        assert not len(rows)
    else:
        assert (best <= edge + 1e-9).all() and best @ best <= square * (1 + 1e-6) and (rows @ weight <= weight @ best + 1e-6).all()


@pytest.mark.parametrize("shape, most", [("falling", 0.3), ("sparse", 0.07), ("one large", 0.04)])
def test_bound_ends_the_walk(shape, most):
    """Rows met, as a share of all, where a few dimensions decide a score."""
    rng, n = np.random.default_rng(0), 4096
    made = {
        "falling": rng.normal(0, 1, (n, 64)) * 0.7 ** np.arange(64),
        "sparse": rng.exponential(1, (n, 64)) * (rng.random((n, 64)) < 0.06),
        "one large": 0.9 * np.eye(64)[rng.integers(0, 64, n)] + rng.normal(0, 0.05, (n, 64)),
    }[shape]
    values = np.floor(1024 * made).astype(np.int64)
    lists = topk.Lists(values, np.arange(n))
    found = [lists.best(q, 10) for q in values[::200]]
    assert all(as_pairs(f) == brute(values, np.arange(n), q, 10) for f, q in zip(found, values[::200]))
    assert np.median([f[3] for f in found]) < most * n


def test_walk_on_embeddings(spark, data):
    """The components of these vectors are like independent ones of one size, so every row comes up in some list before the bound falls; the answers are right all the same."""
    v = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", topk.quantised(F.col("embedding")).alias("v")).where("v is not null").collect()
    values, ids = np.array([r.v for r in v]), np.array([r.vec_id for r in v])
    lists = topk.Lists(values, ids)
    for q in values[::100]:
        found = lists.best(q, 10)
        assert as_pairs(found) == brute(values, ids, q, 10) and found[2] < len(ids)


def test_many_blocks(spark, data, monkeypatch):
    """Candidates in several blocks and queries in several blocks give what one block gives."""
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    one = sorted(map(tuple, topk.top_k_search(v, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(topk, "ROWS", 37)
    monkeypatch.setattr(topk, "QUERIES_EACH", 7)
    for most in (topk.BROADCAST_BYTES, 0):
        assert one == sorted(map(tuple, topk.top_k_search(v.coalesce(1), F.col("vec_id") % 10 == 0, broadcast_bytes=most).collect()))


def test_large_components(spark):
    rows = [(0, [2e4, -3e4]), (1, [2e4, -1e4]), (2, [1e15, 1e15]), (3, [-1e15, 0.0]), (4, [1e300, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k_search(v, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    whole = {i: [min(int(1024 * x), (1 << 63) - 1) for x in e] for i, e in rows}
    held = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))
    want = sorted((-held(sum(a * b for a, b in zip(whole[0], whole[i]))), i) for i in range(1, 5))
    assert got == [(i, -s) for s, i in want]
