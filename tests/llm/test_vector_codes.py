"""Vector codes against plain loops: bounds that never exceed a distance, nearest entries, whole runs and odd vectors."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import codes


def plain_nearest(x, entries):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


def plain_run(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, whole vector). Codes, errors and codebooks by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(rows[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for r in rows] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            mine = [plain_nearest(x, books[p])[0] for x in cut[p]]
            for e in set(mine):
                own = [x for x, m in zip(cut[p], mine, strict=True) if m == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[plain_nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(r[0], r[1], "".join(f"{found[p][k][0]:02x}" for p in range(parts)), sum(found[p][k][1] for p in range(parts))) for k, r in enumerate(rows)]
    return out, sha


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 2**32), st.sampled_from([3, 300, 2**33, 2**62]))
def test_nearest_is_exact(dims, n, seed, most):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-most, most, (n, dims)).tolist()
    entries += entries[: n // 2]
    values = np.concatenate([rng.integers(-most, most, (20, dims)), np.array(entries)])
    book = codes.Entries(entries, (1, 2, 4))
    index, distance, _ = book.nearest(values)
    assert [(int(i), int(d)) for i, d in zip(index, distance, strict=True)] == [plain_nearest(x, entries) for x in values.tolist()]


def test_bounds_never_exceed_and_save_work():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 300, (64, 1)) + rng.normal(0, 30, (64, 16))
    entries, values = np.floor(centre).astype(int), np.floor(centre[rng.integers(0, 64, 500)] + rng.normal(0, 20, (500, 16))).astype(int)
    true = ((values[:, None] - entries[None]) ** 2).sum(2)
    for level in codes.LEVELS:
        a, b = codes.outline(values.astype(float), level), codes.outline(entries.astype(float), level)
        assert (((a[:, None] - b[None]) ** 2).sum(2) <= true * (1 + 1e-9) + 1e-6).all()
    _, _, counted = codes.Entries(entries.tolist()).nearest(values)
    assert counted < 0.25 * true.size


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("code", F.lit("clash")).withColumn("v", F.lit("clash")) if extra else df


def test_run_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (40, 8)).astype(np.float32)
    vectors[10:20] = vectors[3]  # ties
    rows = [(int(k), vectors[k].tolist(), int(k % 3) if k % 7 else None) for k in rng.permutation(40)]
    odd = [(100, None, 1), (101, [None, *[0.1] * 7], 1), (102, [float("nan")] * 8, 2), (103, [float("inf")] * 8, 2), (104, [0.5] * 4, 1), (105, [], 1), (None, [0.25] * 8, 0), (7, vectors[9].tolist(), 5), (7, vectors[9].tolist(), 5)]
    whole = [(i, l, [int(np.floor(float(x) * 1024)) for x in v]) for i, v, l in rows + odd[-3:]]
    want, sha = plain_run(whole, entries=6)
    got = codes.compressed(table(spark, rows + odd, True), entries=6).collect()
    total = {}
    for _, l, _, e in want:
        total[l] = total.get(l, 0) + e
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(((i, c, e, total[l]) for i, l, c, e in want), key=key)
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_few_none_and_huge(spark):
    assert codes.compressed(table(spark, [])).count() == 0
    assert codes.compressed(table(spark, [(1, [0.1, 0.2, 0.3], 0)])).count() == 0  # four does not divide three
    r = codes.compressed(table(spark, [(1, [0.1] * 4, None)])).collect()
    assert [(x.code, x.error, x.label_error) for x in r] == [("00000000", 0, 0)]
    r = codes.compressed(table(spark, [(k, [3e38 * (-1) ** k] * 4, 1) for k in range(3)]), entries=1).collect()
    assert len(r) == 3 and max(x.error for x in r) == 2**63 - 1 == r[0].label_error


@pytest.mark.parametrize("batch", [1, 7])
def test_steps_do_not_matter(spark, data, batch, monkeypatch):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.label, [int(np.floor(float(x) * 1024)) for x in r.embedding]) for r in vectors.where("vec_id < 60").collect()]
    got = codes.compressed(vectors.where("vec_id < 60").repartition(batch), entries=16, rounds=2).collect()
    want, sha = plain_run(rows, entries=16, rounds=2)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, c, e) for i, _, c, e in want) and got[0].codebooks_sha256 == sha
