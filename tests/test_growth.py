"""Work that grows no faster than its input."""

import random
import time

import numpy as np

from siltstone.operators import graphs
from siltstone.operators import retrieval as r
from siltstone.streaming import ingest


def test_moves_are_those_of_all_pairs_without_pairing(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.randrange(60), rng.choice(["removed", "created", "changed"]), f"d{rng.randrange(2)}/f{rng.randrange(6)}") for _ in range(300)]
    events = spark.createDataFrame(rows, "file_id int, s int, kind string, path string").selectExpr("file_id", "timestamp_seconds(s) AS ts", "kind", "path")
    first, last = {}, {}
    for i, a, x, p in rows:
        for j, b, y, q in rows:
            if i is not None and i == j and x == "removed" and y == "created" and 0 <= b - a <= 5:
                first[i, p, a] = min(first.get((i, p, a), (99,)), (b - a, p, q, b))
    for (i, _, _), (gap, p, q, b) in first.items():
        last[i, q, b] = min(last.get((i, q, b), (99,)), (gap, p, q))
    wanted = sorted((p, q, "rename" if p[:2] == q[:2] else "move") for _, p, q in last.values())
    found = ingest.moves(events, 5)
    assert sorted(map(tuple, found.collect())) == wanted and wanted
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_found_in_texts_of_any_length(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé€ ") for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(60)] + [None]
    parts = ["", None, "a", "é", "bé", *(t[5:33] for t in texts[:30] if t), *(t[1:26] for t in texts[30:40] if t)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    asked = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "query_id long, part string")
    wanted = sorted((q, d) for q, p in enumerate(parts) if p for d, t in enumerate(texts) if t and p in t)
    for most in (1_000_000, 3):
        assert sorted(map(tuple, r.containing(docs, asked, most_keys=most).collect())) == wanted
    long = "".join(rng.choice("abcdefgh") for _ in range(1 << 20))
    begun = time.time()
    found = r.containing(spark.createDataFrame([(1, long)], "id long, text string"), spark.createDataFrame([(2, long[-40:])], "query_id long, part string")).collect()
    assert [tuple(x) for x in found] == [(2, 1)] and time.time() - begun < 30  # every character found from the text's beginning took minutes


def test_rolling_hashes_are_of_the_bytes_alone():
    data = np.random.default_rng(0).integers(0, 3, 200).astype(np.uint8)
    for n in (1, 2, 3, 5, 7, 8, 13, 24):
        h, seen = r.rolling(data, n), {}
        assert len(h) == 201 - n and all(seen.setdefault(bytes(data[k : k + n]), h[k]) == h[k] for k in range(len(h))) and len(set(seen.values())) == len(seen)


def test_betweenness_beyond_the_edges_of_a_task_is_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(13)] + [("x", "y"), ("n1", "n2"), ("n1", "n2"), ("n3", "n3")]
    edges = spark.createDataFrame(rows, "source string, target string")
    monkeypatch.setattr(graphs, "WALKED", 60)
    near = lambda df: {x.node_id: round(x.score, 9) for x in df.collect()}
    assert near(graphs.betweenness(edges, most_edges=0)) == near(graphs.betweenness(edges))


def test_betweenness_looks_at_each_edge_of_a_walk_about_once(spark):
    # a path of 2,000 nodes: as many levels, over which all edges were looked at again for each
    path = spark.range(2000).selectExpr("concat('n', lpad(id, 5, '0')) AS source", "concat('n', lpad(id + 1, 5, '0')) AS target").unionByName(spark.createDataFrame([(None, "n00000")], "source string, target string"))
    begun = time.time()
    found = {x.node_id: x.score for x in graphs.betweenness(path, sample=200).collect()}
    assert time.time() - begun < 60 and len(found) == 2001
    ends = lambda k: sum((2000 - k) if r < k else k if r > k else 0 for r in range(200))
    pairs = 2000 * 1999 / 2
    assert all(abs(found[f"n{k:05d}"] - min(1.0, ends(k) * 2001 / 200 / pairs)) < 1e-9 for k in (0, 1, 150, 1000, 2000))


def test_tasks_of_pairs_grow_with_the_rows(spark, monkeypatch):
    from siltstone.operators import graphs
    from siltstone.sources import store

    monkeypatch.setattr(store, "TASK_ROWS", 10)
    rows = spark.range(600).selectExpr("id div 3 as o", "id % 7 as p")
    pairs = graphs.cooccurrence(rows, "o", "p")
    assert pairs.rdd.getNumPartitions() == 120 and pairs.agg({"cooccurrence_count": "sum"}).first()[0] == 600


def test_cycles_over_several_cells_are_those_of_a_plain_walk(spark, monkeypatch):
    from siltstone.operators import graph_cells

    monkeypatch.setattr(graph_cells, "CELL_EDGES", 5)
    rng = random.Random(6)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)] + [("x", "y"), ("y", "x"), ("l", "l"), ("z", "x"), (None, "x")]
    near = {a: {b for c, b in rows if c == a} for a, _ in rows}

    def ahead(a):
        seen, todo = set(), [a]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    reach = {a: ahead(a) for a in near if a}
    sets = {a: frozenset({b for b in reach[a] if a in reach.get(b, ())}) for a in reach if a in reach[a]}
    wanted = sorted((a, min(s), len(s)) for a, s in sets.items())
    found = graphs.cycles(spark.createDataFrame(rows, "source string, target string"))
    assert sorted(map(tuple, found.collect())) == wanted and len({c for _, c, _ in wanted}) > 2
    assert graphs.cycles(spark.createDataFrame([], "source string, target string")).isEmpty()


def test_pairs_of_neighbouring_items_are_counted_before_they_move(spark):
    rng = random.Random(7)
    rows = sorted({(rng.randrange(12), rng.choice([None, *range(15)])) for _ in range(70)}, key=str)
    sets = {k: {i for a, i in rows if a == k and i is not None} for k, _ in rows}
    all_of = {k: sum(a == k for a, _ in rows) for k in sets}
    wanted = sorted((a, b, round(len(x & y) / (all_of[a] + all_of[b] - len(x & y)), 9)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y)
    found = graphs.set_similarity(spark.createDataFrame(rows, "k int, i int"), "k", "i")
    assert sorted((a, b, round(j, 9)) for a, b, j in found.collect()) == wanted
    assert "rangepartitioning(i" in found._jdf.queryExecution().executedPlan().toString()


def test_runs_of_words_are_those_of_a_plain_count(spark, monkeypatch):
    from collections import Counter

    from siltstone.operators import enrich

    monkeypatch.setattr(enrich, "COUNTED_WORDS", 30)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["abc", "Abd", "été", "the", "abc_1", "zz9", "of"]) for _ in range(rng.choice([0, 1, 2, 9, 60]))) for _ in range(40)] + [None, "one"]
    for stop, most in (((), 12), (("the", "nowhere"), 5), (("the",), 1000)):
        wanted = []
        for k, t in enumerate(texts):
            w = [x for x in (t or "").lower().split() if len(x) >= 3]
            runs = Counter(tuple(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1) if w[a] not in stop and w[a + n - 1] not in stop)
            best = sorted(((" ".join(r), len(r), c) for r, c in runs.items()), key=lambda x: (-x[2], -x[1], x[0]))[:most]
            wanted += [(k, *x, place) for place, x in enumerate(best, 1)]
        found = enrich.lexical_candidates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", most=most, stop=stop)
        assert sorted(map(tuple, found.select("id", "phrase", "n", "tf", "rank").collect())) == sorted(wanted)


def test_terms_of_chunks_do_not_move(spark):
    import re

    from siltstone.operators import enrich

    chunks = spark.range(40).selectExpr("id div 4 as f", "id as c", "array(1.0) as v", "transform(sequence(0, int(id % 5)), x -> concat('t', x % 3)) as w")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = enrich.term_weights(chunks, "f", "c", "v", "w")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning(f" in plan and not re.search(r"hashpartitioning\([^()]*_t#", plan)


def test_vectors_of_phrases_stay_in_their_task_whatever_a_batch_holds(spark, monkeypatch):
    from siltstone.operators import enrich

    asked, own = [], enrich.embedded
    monkeypatch.setattr(enrich, "embedded", lambda df, text, model, *more: asked.append(text) or own(df, text, model, *more))
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["abc", "bed", "cab", "dead", "ace", "fade"]) for _ in range(rng.choice([0, 1, 6, 30]))), "a/b.md", "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, language string")
    letters = lambda texts: np.array([[t.count(c) for c in "abcdef"] for t in texts], float).reshape(-1, 6)
    held, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for most in (held, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            found.append(sorted(map(tuple, enrich.enriched(docs, letters).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert found[0] == found[1] and {x[1] for x in found[0]} == {"keyword", "tag", "basket", "structural", "gist"}
    assert set(asked) == {"content"}


def test_pairs_that_cannot_be_alike_do_not_move(spark, monkeypatch):
    rng = random.Random(10)
    # three sets of each twenty are alike, and others share one item of many
    rows = sorted({(k, 1000 * rng.randrange(60) + k % 20) for k in range(60) for _ in range(60)} | {(k, 500 + 1000 * rng.randrange(40)) for k in range(60) for _ in range(2)} | {(1, None)}, key=str)
    sets = {k: {i for a, i in rows if a == k} for k, _ in rows}
    alike = lambda least: sorted((a, b, round(j, 9)) for a, x in sets.items() for b, y in sets.items() if a < b and (j := len((x & y) - {None}) / (len(x) + len(y) - len((x & y) - {None}))) >= least and (x & y) - {None})
    df = spark.createDataFrame(rows, "k int, i int")
    monkeypatch.setattr(graphs, "PAIRED", 50)
    for held in (4_000_000, 200):
        monkeypatch.setattr(graphs, "HELD_ROWS", held)
        for least in (0.15, 0.45, 0.9):
            assert sorted((a, b, round(j, 9)) for a, b, j in graphs.set_similarity(df, "k", "i", least).collect()) == alike(least)
    monkeypatch.setattr(graphs, "HELD_ROWS", 4_000_000)
    few = graphs.near_candidates(df, len(rows), "k", "i", 0.3).distinct().count()
    assert len(alike(0.3)) <= few < len(alike(0)) / 2
