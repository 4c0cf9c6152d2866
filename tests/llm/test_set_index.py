"""The set join's lists: what is skipped and derived, and its passes in many small blocks."""

import numpy as np

from siltstone.llm import setjoin


def family(n, size, edits, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size).astype(np.uint64)
    out = []
    for _ in range(n):
        own, k = base.copy(), int(rng.integers(0, edits + 1))
        own[rng.integers(0, size, k)] = rng.integers(0, 2**63, k).astype(np.uint64)
        out.append(np.unique(own))
    return out


def test_answers_come_from_similar_sets_and_blocks_are_skipped():
    sets = [*family(80, 120, 8), *family(60, 40, 12, 1), *[s[: len(s) // 2] for s in family(20, 120, 8)]]
    index = setjoin.Index(sorted(sets, key=len))
    sets = [set(index.flat[a:b].tolist()) for a, b in zip(index.begins, index.ends)]
    for k in index.order:
        found, counts = index.overlaps(k)
        assert counts.tolist() == [len(sets[k] & sets[x]) for x in found]
        links = {x for x in range(len(sets)) if x != k and 100 * len(sets[k] & sets[x]) >= 75 * len(sets[k] | sets[x])}
        assert links <= set(found.tolist())
    assert index.derived > 3000 and index.skipped > 0


def test_small_blocks_give_the_same(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    whole = sorted(map(tuple, setjoin.jaccard_classes(docs).collect()))
    monkeypatch.setattr(setjoin, "BLOCK", 400)
    monkeypatch.setattr(setjoin, "SEEN", 3)
    assert whole == sorted(map(tuple, setjoin.jaccard_classes(docs, long=3).collect()))


def test_frequent_cells_over_many_tasks(spark):
    """Counts of more tasks than are added up at once."""
    rows = [(c, p, setjoin._pressed(np.full(16_384, p + 1, np.int64) * (1 + 99 * (np.arange(16_384) == c)))) for c in range(setjoin.CELLS // 16_384) for p in range(5)]
    df = spark.createDataFrame(rows, "cell int, part int, counts binary")
    often = np.flatnonzero(np.unpackbits(setjoin.frequent_cells(df, fan=2)))
    assert often.tolist() == [c * 16_384 + c for c in range(setjoin.CELLS // 16_384)]


def test_connected(spark):
    from siltstone.llm.graph import connected

    rng = np.random.default_rng(5)
    for edges in ([], [(1, 1)], [(k, k + 1) for k in range(40)], [tuple(map(int, e)) for e in rng.integers(0, 60, (50, 2))]):
        got = {r.node: r.head for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        head = {x: x for e in edges for x in e}
        for _ in head:
            for a, b in edges:
                head[a] = head[b] = min(head[a], head[b])
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: h for x, h in head.items() if x in linked}


def test_many_sets_that_share_one_shingle_each_with_a_long_one_are_no_class(spark, monkeypatch):
    rng = np.random.default_rng(5)
    one = np.unique(rng.integers(1 << 62, size=300).astype(np.uint64))
    sets = [np.unique(np.append(rng.integers(1 << 62, size=40).astype(np.uint64), one[k])) for k in range(40)]
    sets[7] = np.append(sets[6], np.uint64(1 << 63))
    rows = [(k - 1, len(s), setjoin.sketch(s)) for k, s in enumerate([one, *sets])]
    nodes = spark.createDataFrame(rows, "node long, n long, sketch binary")
    met = spark.createDataFrame([(-1, k) for k in range(40)], "least long, node long")
    edges = {tuple(sorted(r)) for r in setjoin.candidate_edges(met, nodes, long=4).collect()}
    assert edges == {(6, 7)}
    monkeypatch.setattr(setjoin, "MOST_PARTS", 2)
    assert {tuple(sorted(r)) for r in setjoin.candidate_edges(met, nodes, long=4).collect()} == {(-1, k) for k in range(40)}
