"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graphs as g
from siltstone.plans._registry import Registry
from siltstone.sources import views as v

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_BFS = """WITH RECURSIVE e AS (SELECT {a} AS x, {b} AS y, max(weight) AS w FROM {{graph_edges}} GROUP BY ALL),
  t AS (SELECT node_id, 0 AS depth, 1.0::DOUBLE AS c FROM ({start}) UNION SELECT e.y, t.depth + 1, t.c * e.w FROM t JOIN e ON e.x = t.node_id WHERE t.depth < {hops}),
  m AS (SELECT node_id, min(depth) AS depth FROM t GROUP BY node_id)"""
_SOME = "SELECT node_id FROM {graph_nodes} WHERE symbol_name = 'sym_7'"


def _bfs(a, b, start, hops):
    return _BFS.format(a=a, b=b, start=start, hops=hops)


def _some(spark, d):
    return v.graph_nodes(spark, d).where("symbol_name = 'sym_7'").select("node_id")


@query("g01_adjacency", """WITH s AS (SELECT source, target, edge_type, max(weight) AS weight FROM {graph_edges} WHERE weight >= 0.6 GROUP BY ALL), n AS (SELECT count(*) AS n FROM {graph_nodes}), nm AS (SELECT symbol_name, count(*) AS c FROM graph_nodes GROUP BY 1),
  dg AS (SELECT target, count(*) AS c FROM s GROUP BY 1), k AS (SELECT node_id FROM graph_nodes JOIN nm USING (symbol_name) LEFT JOIN dg ON dg.target = node_id, n WHERE nm.c <= greatest(15, n // 500) AND coalesce(dg.c, 0) <= greatest(50, least(n // 150, 125)))
  SELECT source, target, edge_type, weight FROM s WHERE source IN (SELECT node_id FROM k) AND target IN (SELECT node_id FROM k)""")
def g01(spark, d):
    return g.adjacency(v.graph_nodes(spark, d), v.graph_edges(spark, d))


@query("g01b_adjacency_wide", """WITH s AS (SELECT source, target, edge_type, max(weight) AS weight FROM {graph_edges} WHERE weight >= 0.6 GROUP BY ALL), n AS (SELECT count(*) AS n FROM {graph_nodes}), nm AS (SELECT symbol_name, count(*) AS c FROM graph_nodes GROUP BY 1),
  dg AS (SELECT target, count(*) AS c FROM s GROUP BY 1), k AS (SELECT node_id FROM graph_nodes JOIN nm USING (symbol_name) LEFT JOIN dg ON dg.target = node_id, n WHERE nm.c <= greatest(500, n // 500) AND coalesce(dg.c, 0) <= greatest(60, least(n // 150, 125)))
  SELECT source, target, edge_type, weight FROM s WHERE source IN (SELECT node_id FROM k) AND target IN (SELECT node_id FROM k)""")
def g01b(spark, d):
    """With wider bounds, since these tables' names are nearly all too generic for the usual ones."""
    return g.adjacency(v.graph_nodes(spark, d), v.graph_edges(spark, d), least_names=500, least_degree=60)


@query("g02_relations", _bfs("source", "target", _SOME, 3) + " SELECT node_id, m.depth, round(max(c), 6) AS confidence FROM m JOIN t USING (node_id, depth) GROUP BY node_id, m.depth")
def g02(spark, d):
    return g.reachable(v.graph_edges(spark, d), _some(spark, d), 3).select("node_id", "depth", F.round("confidence", 6).alias("confidence"))


@query("g02b_relation_paths", """WITH RECURSIVE e AS (SELECT source, target, max(weight) AS w FROM {graph_edges} GROUP BY ALL), s AS (SELECT node_id FROM {graph_nodes} WHERE symbol_name = 'sym_7'),
  d AS (SELECT node_id, 0 AS depth FROM s UNION SELECT e.target, d.depth + 1 FROM d JOIN e ON e.source = d.node_id WHERE d.depth < 2), m AS (SELECT node_id, min(depth) AS depth FROM d GROUP BY node_id),
  p0 AS (SELECT node_id, 1.0::DOUBLE AS c, node_id AS path FROM s),
  p1 AS (SELECT e.target AS node_id, p.c * w AS c, p.path || ' -> ' || e.target AS path FROM p0 p JOIN e ON e.source = p.node_id JOIN m ON m.node_id = e.target AND m.depth = 1 QUALIFY row_number() OVER (PARTITION BY e.target ORDER BY p.c * w DESC, path) = 1),
  p2 AS (SELECT e.target AS node_id, p.c * w AS c, p.path || ' -> ' || e.target AS path FROM p1 p JOIN e ON e.source = p.node_id JOIN m ON m.node_id = e.target AND m.depth = 2 QUALIFY row_number() OVER (PARTITION BY e.target ORDER BY p.c * w DESC, path) = 1)
  SELECT node_id, 0 AS depth, round(c, 6) AS confidence, path FROM p0 UNION ALL SELECT node_id, 1, round(c, 6), path FROM p1 UNION ALL SELECT node_id, 2, round(c, 6), path FROM p2""")
def g02b(spark, d):
    """With the way to each node, within two steps."""
    return g.relations(v.graph_edges(spark, d), _some(spark, d), 2, budget=None).select("node_id", "depth", F.round("confidence", 6).alias("confidence"), "path")


@query("g03_impact", _bfs("target", "source", "SELECT 's1' AS node_id UNION SELECT 's2'", 2) + " SELECT node_id, depth FROM m WHERE depth > 0")
def g03(spark, d):
    t = spark.createDataFrame([("s1",), ("s2",)], "node_id string")
    return g.impact(v.graph_edges(spark, d), t, 2).select("node_id", "depth")


@query("g04_usages", "SELECT DISTINCT source AS node_id FROM {graph_edges} WHERE target = 's3'")
def g04(spark, d):
    return g.impact(v.graph_edges(spark, d), spark.createDataFrame([("s3",)], "node_id string"), 1).select("node_id")


@query("g05_graph_stats", "SELECT 'node' AS kind, symbol_type AS type, count(*) AS n FROM {graph_nodes} GROUP BY symbol_type UNION ALL SELECT 'edge', edge_type, count(*) FROM {graph_edges} GROUP BY edge_type")
def g05(spark, d):
    a = v.graph_nodes(spark, d).groupBy(F.lit("node").alias("kind"), F.col("symbol_type").alias("type")).agg(F.count("*").alias("n"))
    return a.unionByName(v.graph_edges(spark, d).groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n")))


@query("g06_page_rank")
def g06(spark, d):
    return g.page_rank(v.graph_nodes(spark, d), v.graph_edges(spark, d)).select("node_id", F.round("rank", 9).alias("rank"))


@query("g06b_hotspots")
def g06b(spark, d):
    nodes = v.graph_nodes(spark, d)
    h = g.hotspots(nodes, g.page_rank(nodes, v.graph_edges(spark, d)))
    return h.select("node_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node_id").limit(20)


@query("g07_betweenness")
def g07(spark, d):
    return g.betweenness(v.graph_edges(spark, d)).select("node_id", F.round("score", 9).alias("score"))


@query("g08_communities")
def g08(spark, d):
    e = v.graph_edges(spark, d).where("weight >= 0.6")
    return g.communities(e)


@query("g09_cycles", """WITH RECURSIVE e AS (SELECT DISTINCT source AS s, target AS t FROM {graph_edges}), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
  x AS (SELECT a.s AS node_id, least(a.s, min(a.t)) AS cycle FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY a.s) SELECT node_id, cycle, count(*) OVER (PARTITION BY cycle) AS size FROM x""")
def g09(spark, d):
    return g.cycles(v.graph_edges(spark, d))


@query("g10_test_gaps", _bfs("source", "target", "SELECT node_id FROM {graph_nodes} WHERE is_test".replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}"), 1) + """, dp AS (SELECT target, count(DISTINCT source) AS d FROM graph_edges WHERE source IN (SELECT node_id FROM graph_nodes WHERE NOT is_test) GROUP BY target)
  SELECT node_id, coalesce(d, 0) AS dependents FROM graph_nodes LEFT JOIN dp ON target = node_id WHERE NOT is_test AND symbol_type = 'function' AND node_id NOT IN (SELECT node_id FROM m)""")
def g10(spark, d):
    return g.test_gaps(v.graph_nodes(spark, d), v.graph_edges(spark, d), 1)


@query("g10b_test_gaps_any_depth")
def g10b(spark, d):
    return g.test_gaps(v.graph_nodes(spark, d), v.graph_edges(spark, d))


@query("g10c_test_coverage", _bfs("source", "target", "SELECT node_id FROM {graph_nodes} WHERE is_test".replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}"), 1) + """, k AS (SELECT x.*, 'l' || substr(file_path, 11, 1) AS language FROM graph_nodes x WHERE symbol_type = 'function'), a AS (
  SELECT language, count(*) FILTER (NOT is_test) AS production, count(*) FILTER (NOT is_test AND node_id IN (SELECT node_id FROM m)) AS covered, count(*) FILTER (is_test) AS tests FROM k GROUP BY language),
  z AS (SELECT sum(production)::BIGINT AS production, sum(covered)::BIGINT AS covered, sum(tests)::BIGINT AS tests FROM a), b AS (SELECT max(covered / production) FILTER (production >= 50 AND tests > 0) AS best FROM a)
  SELECT language, a.production, a.covered, a.tests, CASE WHEN NOT (z.tests > 0 AND z.covered / z.production < 0.05) AND a.production >= 50 AND a.tests > 0 AND (a.covered / a.production < 0.05 OR a.covered / a.production < 0.5 * best) THEN 'partial' END AS doubt FROM a, z, b WHERE a.production > 0
  UNION ALL SELECT NULL, production, covered, tests, CASE WHEN tests > 0 AND covered / production < 0.05 THEN 'unreliable' END FROM z""")
def g10c(spark, d):
    """By a letter of the part's brand as the language of its file."""
    nodes = v.graph_nodes(spark, d).where("symbol_type = 'function'")
    nodes = nodes.withColumn("file_path", F.concat(F.lit("src/x.l"), F.substring("file_path", 11, 1)))
    return g.test_coverage(nodes, v.graph_edges(spark, d), 1)


@query("g11_imports", r"""WITH t AS (SELECT doc_id, 'import os.m' || doc_id % 7 || chr(10) || '  from a.b' || doc_id % 5 || ' import c' || chr(10) || 'use std::x' || doc_id % 3 || ';' || chr(10) || '#include <s' || doc_id % 4 || '.h>' || chr(10) || 'import q from "y/' || doc_id % 6 || '"' || chr(10) || coalesce(text, '') AS t FROM documents)
  SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(t, '(?m)^\s*import\s+([A-Za-z_][\w.]*)', 1), regexp_extract_all(t, '(?m)^\s*from\s+([A-Za-z_.][\w.]*)\s+import', 1), regexp_extract_all(t, '(?m)^\s*import\s[^;\n]*?from\s+[''"]([^''"]+)[''"]', 1),
    regexp_extract_all(t, '(?m)^\s*use\s+([A-Za-z_][\w:]*)', 1), regexp_extract_all(t, '(?m)^\s*#include\s+[<"]([^>"]+)[>"]', 1)))) AS module FROM t""")
def g11(spark, d):
    n = lambda k: (F.col("doc_id") % k).cast("string")
    head = F.concat(F.lit("import os.m"), n(7), F.lit("\n  from a.b"), n(5), F.lit(" import c\nuse std::x"), n(3), F.lit(";\n#include <s"), n(4), F.lit('.h>\nimport q from "y/'), n(6), F.lit('"\n'))
    docs = v.base(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return g.imports(docs, "doc_id", "text")


@query("g12_stub_resolution", "WITH k AS (SELECT o_orderkey % 50 AS stub, o_custkey % 7 AS node_id, bool_or(o_orderkey % 11 = 0) AS receiver, bool_or(o_orderkey % 5 = 0) AS same_file FROM orders GROUP BY ALL), m AS (SELECT *, count(*) OVER (PARTITION BY stub) AS n, CASE WHEN receiver THEN 1 WHEN same_file THEN 2 ELSE 9 END AS lv FROM k), b AS (SELECT *, min(CASE WHEN lv = 9 AND n = 1 THEN 4 ELSE lv END) OVER (PARTITION BY stub) AS best FROM m) SELECT stub, min(node_id) AS node_id, CASE best WHEN 1 THEN 'receiver' WHEN 2 THEN 'same_file' WHEN 4 THEN 'unique' END AS tier, CASE best WHEN 1 THEN 0.97 WHEN 2 THEN 1.0 WHEN 4 THEN 0.70 END::DOUBLE AS confidence FROM b WHERE lv = best OR best = 4 GROUP BY stub, best HAVING best < 9 UNION ALL SELECT stub, node_id, 'split', 1.0 / n FROM b WHERE best = 9 AND n <= 10")
def g12(spark, d):
    o = v.base(spark, d, "orders")
    k = o.groupBy((F.col("o_orderkey") % 50).alias("stub"), (F.col("o_custkey") % 7).alias("node_id")).agg(F.max(F.col("o_orderkey") % 11 == 0).alias("receiver"), F.max(F.col("o_orderkey") % 5 == 0).alias("same_file"))
    k = k.withColumns({t: F.lit(False) for t in ("lsp", "caller_class", "import", "same_package")})
    return g.resolved_stubs(k.select("stub").distinct(), k)


@query("g13_merge_nodes", "SELECT node_id, CASE WHEN node_id LIKE 's%' THEN 'renamed' ELSE symbol_name END AS symbol_name, file_path FROM {graph_nodes}")
def g13(spark, d):
    n = v.graph_nodes(spark, d).select("node_id", "symbol_name", "file_path")
    new = n.where("node_id like 's%'").select("node_id", F.lit("renamed").alias("symbol_name"), F.lit(None).cast("string").alias("file_path"))
    return g.merged_nodes(n, new)


@query("g13b_orphan_prune", "SELECT node_id FROM {graph_nodes} WHERE node_id NOT IN (SELECT source FROM {graph_edges} UNION SELECT target FROM graph_edges)")
def g13b(spark, d):
    e = v.graph_edges(spark, d)
    return v.graph_nodes(spark, d).join(e.select(F.col("source").alias("node_id")).union(e.select("target")), "node_id", "left_anti").select("node_id")


@query("g14_graph_context", "SELECT target AS node_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS callers FROM {graph_edges} WHERE edge_type = 'CALLS' GROUP BY target")
def g14(spark, d):
    e = v.graph_edges(spark, d).where("edge_type = 'CALLS'")
    return e.groupBy(F.col("target").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("callers"))


@query("g15_cooccurrence", "SELECT symbol_a, symbol_b, cooccurrence_count FROM {pairs}")
def g15(spark, d):
    return v.pairs(spark, d)


_ENDS = "WITH e AS (SELECT symbol_a AS node, symbol_b AS other, cooccurrence_count AS c FROM {pairs} UNION ALL SELECT symbol_b, symbol_a, cooccurrence_count FROM pairs)"


@query("g16_degree_centrality", _ENDS + " SELECT node, sum(c)::BIGINT AS degree, round(sum(c) / max(sum(c)) OVER (), 9) AS centrality FROM e GROUP BY node")
def g16(spark, d):
    return g.degree_centrality(v.pairs(spark, d)).select("node", "degree", F.round("centrality", 9).alias("centrality"))


def _least_labels(edges: str, rounds: int = 12) -> str:
    """Tables b (both directions of the edges a, b) and l0, l1, ...: the least name within that many steps of each node."""
    steps = f"b AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), l0 AS (SELECT DISTINCT a AS n, a AS c FROM b)"
    for k in range(1, rounds + 1):
        steps += f", l{k} AS (SELECT b.a AS n, least(min(x.c), min(y.c)) AS c FROM b JOIN l{k - 1} x ON x.n = b.b JOIN l{k - 1} y ON y.n = b.a GROUP BY b.a)"
    return steps


@query("g17_clusters", "WITH " + _least_labels("SELECT symbol_a AS a, symbol_b AS b FROM {pairs}") + " SELECT n AS node, c AS component FROM l12")
def g17(spark, d):
    """Clusters of any extent; the SQL twin's twelve steps are more than this graph's diameter."""
    return g.components(v.pairs(spark, d), "symbol_a", "symbol_b")


@query("g18_neighbours", _ENDS + " SELECT other, c AS cooccurrence_count FROM e WHERE node = (SELECT min(symbol_a) FROM pairs) AND c >= 1")
def g18(spark, d):
    p = v.pairs(spark, d)
    return g.neighbours(p, p.agg(F.min("symbol_a")).first()[0], 1)


@query("g19_bridge_proxy", _ENDS + ", x AS (SELECT node, count(*) * (count(*) - 1) // 2 AS bridges FROM e GROUP BY node) SELECT node, bridges, round(bridges / max(bridges) OVER (), 9) AS score FROM x WHERE bridges > 0")
def g19(spark, d):
    return g.bridge_proxy(v.pairs(spark, d)).select("node", "bridges", F.round("score", 9).alias("score"))


@query("g20_concept_scores", _ENDS + " SELECT node, round(0.3 * sum(c) / max(sum(c)) OVER () + 0.7 * (node % 10) / 10.0, 6)::DOUBLE AS score FROM e GROUP BY node")
def g20(spark, d):
    c = g.degree_centrality(v.pairs(spark, d))
    return c.select("node", F.round(g.concept_score(F.col("centrality"), (F.col("node") % 10) / 10.0), 6).alias("score"))


_MEANS = "m AS (SELECT label, [" + ", ".join(f"avg(dense[{k}])" for k in range(1, 65)) + "] AS c FROM {points} GROUP BY label)"


@query("g21_affinity_groups", "WITH RECURSIVE " + _MEANS + """, p AS (SELECT x.label AS a, y.label AS b FROM m x JOIN m y ON x.label < y.label AND list_dot_product(x.c, y.c) / (sqrt(list_dot_product(x.c, x.c)) * sqrt(list_dot_product(y.c, y.c))) >= 0.05),
  e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a, a AS b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b) SELECT a AS node, min(b) AS component FROM c GROUP BY a""")
def g21(spark, d):
    from siltstone.functions.vectors import dimensions, mean_vector
    from siltstone.operators.enrich import similar_pairs

    x = v.points(spark, d)
    m = x.groupBy("label").agg(mean_vector("dense", dimensions(x, "dense")).alias("c"))
    return g.components(similar_pairs(m, "label", "c", 0.05).select("a", "b"), "a", "b")


@query("g22_dependency_groups", "WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), m AS (SELECT x.k AS a, y.k AS b, count(*) AS both_ FROM s x JOIN s y ON x.i = y.i AND x.k < y.k GROUP BY ALL) SELECT a, b, round(both_ / (p.n + q.n - both_), 9) AS jaccard FROM m JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE both_ / (p.n + q.n - both_) >= 0.15")
def g22(spark, d):
    s = v.base(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("i")).distinct()
    return g.set_similarity(s, "k", "i", 0.15).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("p12_confident_answers", "WITH e AS (SELECT source, target, max(weight) AS w FROM {graph_edges} WHERE weight >= 0.7 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, target) AS k, count(*) OVER (PARTITION BY source) AS total FROM e) SELECT source, target, total FROM r WHERE k <= 3")
def p12(spark, d):
    from pyspark.sql import Window as W

    e = v.graph_edges(spark, d).where("weight >= 0.7").groupBy("source", "target").agg(F.max("weight").alias("w"))
    w = W.partitionBy("source")
    return e.withColumn("k", F.row_number().over(w.orderBy(F.desc("w"), "target"))).withColumn("total", F.count("*").over(w)).where("k <= 3").select("source", "target", "total")


@query("s16_graph_export_import", "SELECT source, target, edge_type, weight FROM {graph_edges}")
def s16(spark, d):
    """All edges, written, read back and held against what was written."""
    from siltstone.sources.readers import export_table, import_checked
    from siltstone.sources.store import new_place

    e, path = v.graph_edges(spark, d), new_place(spark, "export")
    export_table(e, path)
    return import_checked(spark, path, e).select("source", "target", "edge_type", "weight")
