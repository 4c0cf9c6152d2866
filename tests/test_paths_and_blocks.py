"""Ways to related nodes, doubts about coverage, queries in blocks, moved folders and turns, against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import graphs as g
from siltstone.operators import retrieval as r
from siltstone.streaming import ingest as s


def test_paths_against_a_plain_walk(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice([0.5, 0.7, 1.0])) for _ in range(70)]
    best = {}
    for a, b, w in edges:
        best[a, b] = max(w, best.get((a, b), 0))
    known = {"n0": (0, 1.0, "n0"), "n1": (0, 1.0, "n1")}
    for depth in (1, 2, 3):
        found = {}
        for (a, b), w in best.items():
            if a in known and known[a][0] == depth - 1 and b not in known:
                found.setdefault(b, []).append((-known[a][1] * w, f"{known[a][2]} -> {b}"))
        known |= {b: (depth, -min(ways)[0], min(ways)[1]) for b, ways in found.items()}
    df = spark.createDataFrame(edges, "source string, target string, weight double")
    start = spark.createDataFrame([("n0",), ("n1",), ("n1",)], "node_id string")
    got = {x.node_id: (x.depth, x.confidence, x.path) for x in g.relations(df, start, 3).collect()}
    assert got.keys() == known.keys() and all(got[k][0] == known[k][0] and abs(got[k][1] - known[k][1]) < 1e-12 for k in known)
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in known.items()}
    assert {x.depth for x in g.relations(df, start, 3, budget=3).collect()} == {0, 1}


def test_doubts(spark):
    def coverage(*languages):
        """(extension, production, covered, tests) as a graph."""
        nodes, edges = [], []
        for ext, n, covered, tests in languages:
            nodes += [(f"{ext}{k}", "function", f"a/b.{ext}", False) for k in range(n)] + [(f"t{ext}{k}", "function", f"a/t.{ext}", True) for k in range(tests)]
            edges += [(f"t{ext}0", f"{ext}{k}", 1.0) for k in range(covered)]
        out = g.test_coverage(spark.createDataFrame(nodes, "node_id string, symbol_type string, file_path string, is_test boolean"), spark.createDataFrame(edges, "source string, target string, weight double"), 1)
        return {x.language: (x.production, x.covered, x.tests, x.doubt) for x in out.collect()}

    assert coverage(("py", 60, 40, 2), ("rs", 60, 10, 1), ("go", 40, 1, 1), ("ts", 80, 0, 0)) == {"py": (60, 40, 2, None), "rs": (60, 10, 1, "partial"), "go": (40, 1, 1, None), "ts": (80, 0, 0, None), None: (240, 51, 4, None)}
    assert coverage(("py", 100, 4, 2), ("rs", 60, 1, 1))[None] == (160, 5, 3, "unreliable")
    assert coverage(("py", 100, 4, 2), ("rs", 60, 1, 1))["py"][3] is None


def test_queries_in_blocks_are_those_in_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(60)], "id long, dense array<double>")
    asked = points.where("id < 20").select(F.col("id").alias("query_id"), F.col("dense").alias("vector"))
    key = lambda df: sorted((x.query_id, x.rank, x.id, round(x.score, 12)) for x in df.collect())
    one = key(r.dense_search(points, asked, 4))
    monkeypatch.setattr(r, "BLOCK_QUERIES", 3)
    assert key(r.dense_search(points, asked, 4)) == one and len(one) == 80
    assert r.dense_search(points, asked.where("false"), 4).count() == 0


def test_moved_folders_are_known_by_name(spark):
    rows = [(None, 0, "removed", "a/lib", True), (None, 5, "created", "b/lib", True), (None, 0, "removed", "a/x.py", False), (None, 5, "created", "b/x.py", False), (7, 0, "removed", "a/y.py", False), (7, 9, "created", "a/z.py", False), (None, 0, "removed", "a/far", True), (None, 99, "created", "b/far", True)]
    df = spark.createDataFrame(rows, "file_id long, at int, kind string, path string, folder boolean").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted(map(tuple, s.moves(df, 10, is_folder="folder").collect())) == [("a/lib", "b/lib", "move"), ("a/y.py", "a/z.py", "rename")]
    assert sorted(map(tuple, s.moves(df, 10).collect())) == [("a/y.py", "a/z.py", "rename")]


def test_turns_keep_their_first_in_each_task(spark):
    queue = spark.range(1000).select(F.col("id").alias("queue_id"), (F.col("id") % 5).alias("priority"), (F.col("id") % 97).alias("created_at"))
    turns = s.fair_turns(queue, 2, 1, 9)
    assert "WindowGroupLimit" in turns._jdf.queryExecution().executedPlan().toString()
    assert [x.priority <= 2 for x in turns.orderBy("place").collect()] == [True, True, False] * 3
