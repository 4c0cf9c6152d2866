"""Queries of filters, joins, set operations, limits and windows in their plain forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import cleaned
from siltstone.operators import enrich as e
from siltstone.operators import graphs as g
from siltstone.operators import retrieval as r
from siltstone.operators import telemetry as t
from siltstone.operators import textsearch as x
from siltstone.plans._registry import Registry
from siltstone.sources import views as v
from siltstone.sources.readers import read_files
from siltstone.sources.store import new_place, spread_by

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("s13_texts_of_pages", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[^\S\n]+', ' ', 'g'), ' ') AS body FROM pages")
def s13(spark, d):
    return v.base(spark, d, "pages").select("page_id", cleaned(F.regexp_replace("html", "<[^>]*>", "")).alias("body"))


@query("s13b_read_files", "SELECT page_id, length(html) + 1 AS characters, md5(html || chr(10)) AS md5, 'utf-8' AS encoding FROM pages WHERE html IS NOT NULL")
def s13b(spark, d):
    """Each page as a file of its own, found and read again by the reader of files."""
    place = new_place(spark, "files")
    v.base(spark, d, "pages").where("html is not null").select("page_id", "html").write.partitionBy("page_id").text(place)
    found = read_files(spark, place, "*.txt").where("error is null")
    page = F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("long")
    return found.select(page.alias("page_id"), F.length("text").cast("long").alias("characters"), F.md5("text").alias("md5"), "encoding")


_HOSTS = ("localhost:8080", "127.0.0.1", "10.1.2.3", "172.20.0.1", "172.32.0.1", "169.254.169.254", "192.168.1.1", "0.0.0.0", "[::1]:80", "[fd00::1]", "[fe80::1]", "[2001:db8::1]", "u:p@10.0.0.1", "100.64.0.1", "8.8.8.8", "a.internal")


@query("s15_web_ingest", r"""WITH p AS (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN 'http://' || (["""
    + ", ".join(f"'{h}'" for h in _HOSTS)
    + r"""])[page_id // 3 % 16 + 1] || '/x' ELSE url END AS url, page_id % 3 <> 0 OR page_id // 3 % 16 IN (4, 11, 14) AS good FROM pages)
  SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)) AS host, regexp_matches(html, '(?i)<title') AS titled FROM p WHERE good""")
def s15(spark, d):
    """Pages whose address may be asked; every third has an address of this machine, of a private range or like one."""
    from siltstone.functions.paths import public_url, url_host

    made = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.floor(F.col("page_id") / 3) % len(_HOSTS) + 1).cast("int"))
    p = v.base(spark, d, "pages").withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://"), made, F.lit("/x"))).otherwise(F.col("url")))
    return p.where(public_url(F.col("url"))).select("page_id", url_host(F.col("url")).alias("host"), F.col("html").rlike("(?i)<title").alias("titled"))


def _scoped(spark, d):
    f = v.files(spark, d)
    return f.select("file_id", "tenant_id", F.col("language").alias("branch"), F.when(F.col("file_path").endswith(".py"), "code").otherwise("text").alias("file_type"), F.when(F.col("file_id") % 4 == 0, F.array(F.lit("test"), F.lit("a"))).otherwise(F.array(F.lit("b"))).alias("tags"), F.concat_ws(".", "tenant_id", "language").alias("component"), (F.col("file_id") % 10 == 0).alias("deleted"))


@query("p01_scope_filter", "SELECT file_id FROM {files} WHERE tenant_id IN ('src1') AND language IN ('en', 'fr') AND file_path LIKE '%.py' AND file_id % 4 <> 0 AND file_id % 10 <> 0")
def p01(spark, d):
    test = r.scope_filter(tenant="src1", branch="en", fallback="fr", file_types=["code"], component="src1", not_deleted=True, no_tests=True)
    return _scoped(spark, d).where(test).select("file_id")


@query("p02_equality_filter", "SELECT file_id FROM {files} WHERE tenant_id = 'src5' AND file_id % 10 <> 0")
def p02(spark, d):
    return _scoped(spark, d).where(r.payload_filter({"tenant_id": "src5", "deleted": False, "file_id": 1.5})).select("file_id")


@query("p11_scope_recheck", "SELECT file_id FROM {files} WHERE tenant_id = 'src6' AND list_has_all(branches, ['main', 'en'])")
def p11(spark, d):
    f = v.files(spark, d)
    return f.where((F.col("tenant_id") == "src6") & (F.size(F.array_except(F.array(F.lit("main"), F.lit("en")), "branches")) == 0)).select("file_id")


@query("p16_served_metadata", "SELECT file_id, language, nullif(CASE WHEN file_id % 3 = 0 THEN '' ELSE tenant_id END, '') AS tenant_id FROM {files}")
def p16(spark, d):
    return v.files(spark, d).select("file_id", "language", F.nullif(F.when(F.col("file_id") % 3 == 0, "").otherwise(F.col("tenant_id")), F.lit("")).alias("tenant_id"))


@query("j01_inner_join", "SELECT f.tenant_id, count(*) AS n FROM {lines} l JOIN {files} f USING (file_id) WHERE l.line_number = 1 GROUP BY f.tenant_id")
def j01(spark, d):
    first = v.lines(spark, d).where("line_number = 1")
    return first.join(v.files(spark, d).select("file_id", "tenant_id"), "file_id").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("j02_left_join_counts", "SELECT c_mktsegment AS segment, count(o_orderkey) AS orders, count(*) FILTER (o_orderkey IS NULL) AS idle FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_mktsegment")
def j02(spark, d):
    o = v.base(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return v.base(spark, d, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("idle"))


@query("j06_range_self_join", "SELECT DISTINCT a.id FROM {search_events} a JOIN search_events b ON a.session_id = b.session_id AND a.tool = b.tool AND b.op = 'followup' AND b.parent_event_id IS NULL AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 1 AND 7200000000")
def j06(spark, d):
    w = W.partitionBy("session_id", "tool").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, 7_200_000_000)
    soon = F.max(F.when((F.col("op") == "followup") & F.col("parent_event_id").isNull(), 1).otherwise(0)).over(w)
    return v.search_events(spark, d).withColumn("_soon", soon).where("_soon = 1").select("id")


@query("j07_incident_edge_pairs", "WITH e AS (SELECT symbol_a AS node, symbol_b AS other FROM {pairs} UNION ALL SELECT symbol_b, symbol_a FROM pairs) SELECT x.node, count(*) AS bridges FROM e x JOIN e y ON x.node = y.node AND x.other < y.other GROUP BY x.node")
def j07(spark, d):
    return g.bridge_proxy(v.pairs(spark, d)).select("node", "bridges")


@query("j12_hit_neighbours", "SELECT n.node_id, coalesce(array_to_string(list_sort(list(DISTINCT e.target) FILTER (e.target IS NOT NULL)), ','), '') AS callees FROM {graph_nodes} n LEFT JOIN {graph_edges} e ON e.source = n.node_id AND e.edge_type = 'CALLS' GROUP BY n.node_id")
def j12(spark, d):
    calls = v.graph_edges(spark, d).where("edge_type = 'CALLS'").groupBy(F.col("source").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("callees"))
    return v.graph_nodes(spark, d).join(calls, "node_id", "left").select("node_id", F.coalesce("callees", F.lit("")).alias("callees"))


@query("j13_context_join", "WITH m AS (SELECT file_id, line_number FROM {lines} WHERE contains(content, 'token')) SELECT m.file_id, m.line_number, count(l.line_number) AS near FROM m LEFT JOIN lines l ON l.file_id = m.file_id AND l.line_number BETWEEN m.line_number - 3 AND m.line_number + 3 AND l.line_number <> m.line_number GROUP BY ALL")
def j13(spark, d):
    l = v.lines(spark, d)
    m = x.with_context(x.exact_matches(l, "token").select("file_id", "line_number"), l, 3)
    return m.select("file_id", "line_number", (F.size("before") + F.size("after")).cast("long").alias("near"))


@query("j14_actionable_stubs", "SELECT DISTINCT target FROM {graph_edges} WHERE weight < 0.6 AND target IN (SELECT node_id FROM {graph_nodes} WHERE symbol_type = 'class')")
def j14(spark, d):
    weak = v.graph_edges(spark, d).where("weight < 0.6").select("target").distinct()
    return weak.join(v.graph_nodes(spark, d).where("symbol_type = 'class'").select(F.col("node_id").alias("target")), "target", "left_semi")


@query("a16_degree_sums", "WITH e AS (SELECT symbol_a AS node, cooccurrence_count AS c FROM {pairs} UNION ALL SELECT symbol_b, cooccurrence_count FROM pairs) SELECT node, sum(c)::BIGINT AS degree FROM e GROUP BY node")
def a16(spark, d):
    return g.degree_centrality(v.pairs(spark, d)).select("node", "degree")


@query("a20_pair_upsert", "SELECT symbol_a, symbol_b, cooccurrence_count * 2 AS cooccurrence_count FROM {pairs}")
def a20(spark, d):
    p = v.pairs(spark, d)
    # an order's lines make about one and a half pairs each, which come twice
    both = spread_by(p.unionByName(p), 3 * v.base(spark, d, "lineitem").count(), "symbol_a", "symbol_b")
    return both.groupBy("symbol_a", "symbol_b").agg(F.sum("cooccurrence_count").alias("cooccurrence_count"))


@query("w02_line_numbers", "SELECT file_id, line_number, row_number() OVER (PARTITION BY file_id ORDER BY line_number DESC) AS rn FROM {lines}")
def w02(spark, d):
    return v.lines(spark, d).select("file_id", "line_number", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("line_number"))).cast("long").alias("rn"))


@query("w07_first_per_key", "SELECT tenant_id, min(id) AS id FROM {points} GROUP BY tenant_id")
def w07(spark, d):
    p = v.points(spark, d).select(F.lit(0).alias("query_id"), "id", "tenant_id", F.col("id").alias("rank"))
    return r.first_of_each(p, F.col("tenant_id")).select("tenant_id", "id")


@query("k01_top_k_with_ties", "SELECT id, latency_ms FROM {search_events} ORDER BY latency_ms DESC, id LIMIT 30")
def k01(spark, d):
    return v.search_events(spark, d).select("id", "latency_ms").orderBy(F.desc("latency_ms"), "id").limit(30)


@query("k03_keyset_paging", "SELECT DISTINCT file_path FROM {files} WHERE file_path > 'src3/' ORDER BY file_path LIMIT 12")
def k03(spark, d):
    return r.after(v.files(spark, d).select("file_path").distinct(), "file_path", "src3/", 12)


@query("k04_nulls_last", "SELECT file_id, size_bytes FROM {files} ORDER BY size_bytes ASC NULLS LAST, file_id LIMIT 20")
def k04(spark, d):
    return v.files(spark, d).select("file_id", "size_bytes").orderBy(F.col("size_bytes").asc_nulls_last(), "file_id").limit(20)


@query("k06_capped_matches", "WITH m AS (SELECT DISTINCT content FROM {lines} WHERE contains(content, 'the')) SELECT content, (SELECT count(*) FROM m) > 15 AS truncated FROM m ORDER BY content LIMIT 15")
def k06(spark, d):
    return x.capped(x.exact_matches(v.lines(spark, d), "the").select("content").distinct(), ["content"], 15)


@query("u01_union_all", "SELECT symbol_a AS node FROM {pairs} UNION ALL SELECT symbol_b FROM pairs")
def u01(spark, d):
    return g.ends(v.pairs(spark, d)).select("node")


@query("u02_union_distinct", "SELECT source AS node FROM {graph_edges} UNION SELECT target FROM graph_edges")
def u02(spark, d):
    ed = v.graph_edges(spark, d)
    return ed.select(F.col("source").alias("node")).union(ed.select("target")).distinct()


@query("u03_array_union", "SELECT file_id, array_to_string(list_sort(list_distinct(list_concat(branches, ['main', 'next']))), ',') AS branches FROM {files}")
def u03(spark, d):
    return v.files(spark, d).select("file_id", F.array_join(F.array_sort(F.array_union("branches", F.array(F.lit("main"), F.lit("next")))), ",").alias("branches"))


@query("r06_dense_in_scope", "SELECT p.id, round(list_dot_product(p.dense, q.dense) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(q.dense, q.dense))), 6) AS score FROM {points} p, (SELECT dense FROM points WHERE id = 5) q WHERE p.tenant_id = 't3' ORDER BY score DESC, p.id LIMIT 10")
def r06(spark, d):
    p = v.points(spark, d)
    q = p.where("id = 5").select(F.lit(0).alias("query_id"), F.col("dense").alias("vector"))
    return r.dense_search(p.where("tenant_id = 't3'"), q, 10).select("id", F.round("score", 6).alias("score"))


@query("r30_empty_diagnosis", "SELECT 'case' AS reason, count(*) AS n FROM {lines} WHERE contains(lower(content), 'thatand') AND NOT contains(content, 'THATAND') UNION ALL SELECT 'scope', count(*) FROM lines WHERE contains(content, 'thatand')")
def r30(spark, d):
    """Why a search for THATAND in one project has nothing: what other case or scope would give, in one pass."""
    l = v.lines(spark, d)
    case = F.lower("content").contains("thatand") & ~F.col("content").contains("THATAND")
    n = l.agg(F.count_if(case).alias("case"), F.count_if(F.col("content").contains("thatand")).alias("scope"))
    return n.unpivot([], ["case", "scope"], "reason", "n")


@query("e04_fallback_chunks", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 8), 56)) AS a FROM w WHERE len(w) > 0) SELECT doc_id, count(*) AS chunks FROM s GROUP BY doc_id")
def e04(spark, d):
    c = e.chunked(v.base(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", e.token_chunks, size=64, overlap=8)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("e18_hierarchy_rebuild")
def e18(spark, d):
    p = v.points(spark, d).select(F.col("tenant_id").alias("tenant"), F.concat(F.lit("tag"), F.col("id").cast("string")).alias("tag"), F.col("id").alias("documents"), F.col("dense").alias("vector"))
    return e.tag_levels(p, "tenant", 0.3, 0.1)


@query("d11_library_counts", "SELECT tenant_id, count(*) AS documents FROM {files} GROUP BY tenant_id")
def d11(spark, d):
    return t.group_counts(v.files(spark, d), "tenant_id").withColumnRenamed("n", "documents")


@query("d21_metric_summary", "SELECT event_type AS metric_name, count(*) AS n, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type")
def d21(spark, d):
    ev = v.base(spark, d, "events").where("ts >= timestamp_ntz '2024-01-05 00:00:00'")
    return ev.groupBy(F.col("event_type").alias("metric_name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
