"""Graph algorithms that SQL does not state, against plain versions."""

import collections
import math

import numpy as np
import pytest

from siltstone.operators import graphs as g


def table(spark, edges):
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source string, target string, weight double")


def random_edges(seed, n, m):
    rng = np.random.default_rng(seed)
    return [(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2)) if a != b]


def brute_rank(nodes, edges):
    out = collections.defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        lost = sum(r for x, r in rank.items() if not out[x])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for a in nodes:
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        moved = max(abs(new[x] - rank[x]) for x in nodes)
        rank = new
        if moved < 1e-6:
            break
    return rank


def test_page_rank_converges(spark):
    edges = random_edges(1, 30, 70) + [("n1", "n2"), ("n1", "n2"), ("lone", "n3")]
    nodes = sorted({x for e in edges for x in e} | {"apart"})
    df = spark.createDataFrame([(x, f"s{len(x)}") for x in nodes], "node_id string, symbol_name string")
    got = {r.node_id: r.rank for r in g.page_rank(df, table(spark, edges)).collect()}
    want = brute_rank(nodes, edges)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    names = collections.Counter(len(x) for x in nodes)
    scores = {r.node_id: r.score for r in g.hotspots(df, g.page_rank(df, table(spark, edges))).collect()}
    assert all(abs(scores[x] - want[x] * max(0, math.log(len(nodes) / names[len(x)]))) < 1e-12 for x in want)


def brute_betweenness(edges):
    near = collections.defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    names = sorted(near)

    def walks(a):
        """Least distance to each node, and in how many ways."""
        far, ways, ring = {a: 0}, collections.Counter({a: 1}), [a]
        while ring:
            after = []
            for x in ring:
                for y in near[x]:
                    if y not in far:
                        far[y] = far[x] + 1
                        after.append(y)
                    if far[y] == far[x] + 1:
                        ways[y] += ways[x]
            ring = after
        return far, ways

    found = {x: walks(x) for x in names}
    total = dict.fromkeys(names, 0.0)
    for a in names:
        far, ways = found[a]
        for c in names:
            if c == a or c not in far:
                continue
            for x in names:
                if x not in (a, c) and x in far and c in found[x][0] and far[x] + found[x][0][c] == far[c]:
                    total[x] += ways[x] * found[x][1][c] / ways[c]
    pairs = (len(names) - 1) * (len(names) - 2) / 2
    return {x: min(1.0, t / pairs) for x, t in total.items()}


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_betweenness_of_all_sources(spark, cells):
    edges = random_edges(2, 24, 34) + [("n1", "n2"), ("n1", "n2"), ("x", "y"), ("y", "z")]
    got = {r.node_id: r.score for r in g.betweenness(table(spark, edges), cells=cells).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def brute_communities(edges):
    near = collections.defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    label = {x: x for x in near}
    for _ in range(50):
        old = dict(label)
        for x in sorted(near):
            votes = collections.Counter(label[y] for y in near[x])
            label[x] = min(votes, key=lambda k: (-votes[k], k))
        if old == label:
            break
    sizes = collections.Counter(label.values())
    return {(x, c, sizes[c]) for x, c in label.items() if sizes[c] >= 2}


def test_communities_of_separate_parts_are_those_of_the_whole(spark):
    edges = random_edges(3, 14, 20) + [(f"m{a}", f"m{b}") for a, b in [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)]] + [("z1", "z2")]
    got = {(r.node_id, r.community, r.size) for r in g.communities(table(spark, edges)).collect()}
    assert got == brute_communities(edges)


def test_an_export_that_lost_or_changed_rows_is_found(spark, tmp_path):
    from siltstone.sources.readers import export_table, import_checked

    rows, path = spark.range(10), str(tmp_path / "out")
    export_table(rows, path)
    assert import_checked(spark, path, rows).count() == 10
    for other in (spark.range(11), spark.range(1, 11)):
        with pytest.raises(ValueError, match="exported"):
            import_checked(spark, path, other)
