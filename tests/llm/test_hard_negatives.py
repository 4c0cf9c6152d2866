"""Hard negatives against brute force: brackets, ranges, ties, repeated ids, huge and odd vectors, many blocks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import negatives as hn


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (id, label, whole vector, is anchor) of those that take part."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    held = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
    for n, (i, l, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(held(dot(v, w)), j, m) for k, (j, m, w, _) in enumerate(rows) if k != n]
        first = sorted(((s, j) for s, j, m in scored if m == l and j != i), key=lambda x: (-x[0], x[1]))[:positives]
        for p, j in first:
            found = sorted(((s, k) for s, k, m in scored if m != l and low * p <= 100 * s <= high * p), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(found, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect())


def whole(rows, scale=256):
    return [(i, l, [int(np.floor(float(np.float32(x)) * scale)) for x in v], i % 5 == 0) for i, v, l in rows]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("clash")).withColumn("l", F.lit("clash"))


@settings(max_examples=200, deadline=None)
@given(st.integers(-400, 400))
def test_between(p):
    got = hn.between(p)
    want = [n for n in range(-500, 501) if 50 * p <= 100 * n <= 95 * p]
    assert (want == []) if got is None else (got[0], got[1]) == (want[0], want[-1])


def test_brackets_hold_all_scores():
    rng = np.random.default_rng(2)
    values = rng.integers(-300, 300, (400, 12))
    space = hn.Space(values[:100].astype(float), float((values**2).sum(1).max()), 6)
    far, own = space.far(values.astype(float)), np.zeros(400, np.int64)
    block = hn.Block({"ids": np.arange(400).tobytes(), "numbers": np.arange(400).tobytes(), "labels": own.tobytes(), "values": values.tobytes(), "far": far.tobytes()}, 12, space)
    for q in rng.integers(-400, 400, (30, 12)):
        score, at = values @ q, space.far(q[None].astype(float), query=True)[0]
        below, above = block.brackets(np.arange(400), at, float(q @ q))
        assert (below <= score).all() and (score <= above).all() and score.max() <= block.above(at, float(q @ q))


def test_clustered_vectors_are_mostly_not_compared():
    rng = np.random.default_rng(3)
    # of about one norm, as embeddings are: then a vector's own point is near that of its query
    centre = rng.normal(0, 200, (20, 16))
    centre *= 800 / np.sqrt((centre**2).sum(1))[:, None]
    values = np.floor(centre[rng.integers(0, 20, 2000)] + rng.normal(0, 10, (2000, 16))).astype(np.int64)
    space = hn.Space(values.astype(float), float((values**2).sum(1).max()), 8)
    far, labels = space.far(values.astype(float)), np.zeros(2000, np.int64)
    block = hn.Block({"ids": np.arange(2000).tobytes(), "numbers": np.arange(2000).tobytes(), "labels": labels.tobytes(), "values": values.tobytes(), "far": far.tobytes()}, 16, space)
    for q in range(20):
        at = space.far(values[q][None].astype(float), query=True)[0]
        got = block.best_of_label(0, q, q, values[q], at, 5, None)
        score = values @ values[q]
        assert got == sorted(((int(score[k]), k) for k in range(2000) if k != q), key=lambda x: (-x[0], x[1]))[:5]
    assert block.compared < 0.2 * 20 * 2000


@pytest.mark.parametrize("rows_each, anchors_each", [(4096, 4096), (7, 3)])
def test_against_brute_force(spark, monkeypatch, rows_each, anchors_each):
    monkeypatch.setattr(hn, "ROWS", rows_each)
    monkeypatch.setattr(hn, "ANCHORS_EACH", anchors_each)
    monkeypatch.setattr(hn, "BLOCKS_EACH", 2)
    rng = np.random.default_rng(4)
    vectors = rng.normal(0.1, 0.3, (90, 6)).astype(np.float32)
    vectors[30:60] = vectors[7]  # a third alike: ties
    rows = [(int(k), vectors[k].tolist(), int(k % 4)) for k in rng.permutation(90)]
    rows += [(10, vectors[2].tolist(), 1), (10, vectors[2].tolist(), 1), (15, vectors[3].tolist(), 3)]  # repeated ids
    odd = [(200, None, 1), (205, [0.1, None, *[0.1] * 4], 1), (210, [float("nan")] * 6, 1), (215, [0.5] * 6, None), (None, [0.5] * 6, 1), (220, [0.5] * 3, 1), (225, [], 1)]
    assert mined(table(spark, rows + odd)) == brute(whole(rows)) != []


def test_huge_negative_and_few(spark):
    rows = [(k, [3e38 * (1 if k % 3 else -1)] * 2, k % 2) for k in range(12)]
    limit = lambda v: [max(-(1 << 63), min(x, (1 << 63) - 1)) for x in v]
    assert mined(table(spark, rows), low=50, high=100) == brute([(i, l, limit(v), a) for i, l, v, a in whole(rows)], low=50, high=100)
    apart = [(k, [(-1.0) ** (k // 2), 0.1 * k], k % 2) for k in range(8)]
    assert mined(table(spark, apart)) == brute(whole(apart))
    assert mined(table(spark, [])) == [] and mined(table(spark, [(5, [1.0], 0)])) == []


def test_other_labels(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(0.2, 0.3, 4).astype(np.float32).tolist(), k % 3) for k in range(40)]
    df = table(spark, rows)
    assert mined(df, label=F.concat(F.lit("l"), F.col("label").cast("string"))) == mined(df) == brute(whole(rows))
