"""Queries of dense, sparse and hybrid retrieval, points and paging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as ft
from siltstone.functions.paths import below_prefix
from siltstone.functions.vectors import cosine, dimensions, mean_vector
from siltstone.operators import retrieval as r
from siltstone.plans import indexes
from siltstone.plans._registry import Registry
from siltstone.sources import views as v

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

ASKED = ("that", "ouer", "token", "license", "here", "tion")
_TERMS = r"""raw AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\s()\[\]{}<>"''`.,:;~!@#$%^&*+=|\\]+'), lambda x: regexp_replace(x, '^[-_/]+|[-_/]+$', '', 'g')), lambda x: strlen(x) > 1) AS w FROM documents),
  tok AS (SELECT id, unnest(w) AS t FROM raw),
  cut AS (SELECT id, t, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z])([A-Z][a-z])', '\1-\2', 'g'), '[_\-]+'), lambda x: lower(x)), lambda x: strlen(x) > 1) AS ps FROM tok),
  al AS (SELECT id, lower(t) AS term FROM tok UNION ALL SELECT id, unnest(ps) FROM cut WHERE len(ps) >= 2 AND NOT contains(t, '/')),
  post AS (SELECT id, term, count(*) AS tf FROM al WHERE NOT regexp_matches(term, '^[0-9a-f]{8,}$|^v?[0-9]+(\.[0-9]+)+$|[/\\]|^0x|^[0-9]+$') GROUP BY id, term),
  lex AS (SELECT term, count(*) AS df FROM post GROUP BY term), nn AS (SELECT count(*) AS n FROM documents),
  wt AS (SELECT id, term, greatest(0, ln((n - df + 0.5) / (df + 0.5))) * (tf * 1.2) / (tf + 1.2) AS weight FROM post JOIN lex USING (term), nn WHERE greatest(0, ln((n - df + 0.5) / (df + 0.5))) > 0)"""
_ASK = ", ".join(f"('{t}')" for t in ASKED)
_SPARSE = _TERMS + f""",
  sp AS (SELECT id, round(sum(weight), 9) AS score FROM wt WHERE term IN (SELECT * FROM (VALUES {_ASK})) GROUP BY id),
  spr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sp)"""
_DENSE = """dn AS (SELECT p.id, list_dot_product(p.dense, q.dense) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(q.dense, q.dense))) AS score FROM {points} p, (SELECT dense FROM points WHERE id = 0) q),
  dnr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dn)"""


def _dense(spark, d, k, threshold=None):
    p = v.points(spark, d)
    return r.dense_search(p, p.where("id = 0").select(F.lit(0).alias("query_id"), F.col("dense").alias("vector")), k, threshold)


def _asked(spark):
    return spark.createDataFrame([(0, t, 1.0) for t in ASKED], "query_id int, term string, q double")


def _sparse(spark, d, k, segments=1):
    return indexes.sparse(spark, d, segments).search(_asked(spark), k)


@query("s01_dense_search", "WITH " + _DENSE + " SELECT id, round(score, 6) AS score, rank::INTEGER AS rank FROM dnr WHERE rank <= 20")
def s01(spark, d):
    return _dense(spark, d, 20).select("id", F.round("score", 6).alias("score"), "rank")


def _twentieth(spark, d):
    return v.points(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("vector"))


@query("s01b_ann_search")
def s01b(spark, d):
    """About the ten most similar points of every twentieth, out of the index; tested by its recall."""
    return indexes.vectors(spark, d).search(_twentieth(spark, d), 10)


@query("s01c_ann_recall", "SELECT count(*) AS queries, true AS nine_in_ten FROM {points} WHERE id % 20 = 0")
def s01c(spark, d):
    """Whether the index finds nine in ten of what a scan of all points finds."""
    asked = _twentieth(spark, d)
    exact = r.dense_search(v.points(spark, d), asked, 10).select("query_id", "id")
    found = indexes.vectors(spark, d).search(asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_in_ten"))


@query("s01d_ann_all_cells", "WITH q AS (SELECT id AS query_id, dense AS v FROM {points} WHERE id % 20 = 0), s AS (SELECT query_id, p.id, list_dot_product(p.dense, v) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(v, v))) AS score FROM points p, q) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 3")
def s01d(spark, d):
    """With all cells read, codes tell the best of which exact scores are taken."""
    return indexes.vectors(spark, d).search(_twentieth(spark, d), 3, probe=1 << 20, rescore=40).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("p09_score_threshold", "WITH " + _DENSE + " SELECT id, round(score, 6) AS score FROM dnr WHERE score >= 0.2 AND rank <= 50")
def p09(spark, d):
    return _dense(spark, d, 50, 0.2).select("id", F.round("score", 6).alias("score"))


@query("r02_document_frequencies", "WITH " + _TERMS + " SELECT term, df FROM lex")
def r02(spark, d):
    return r.lexicon(r.postings(v.base(spark, d, "documents"), "doc_id", "text"))


@query("r03_sparse_weights", "WITH " + _TERMS + " SELECT id, term, round(weight, 6) AS weight FROM wt")
def r03(spark, d):
    docs = v.base(spark, d, "documents").select("doc_id", "text")
    posts = r.postings(docs, "doc_id", "text")
    return r.sparse_weights(posts, r.lexicon(posts), docs.count()).select("id", "term", F.round("weight", 6).alias("weight"))


@query("r04_vocabulary_without_hapaxes", "WITH " + _TERMS + " SELECT count(*) AS terms, sum(df)::BIGINT AS total FROM lex WHERE df > 1")
def r04(spark, d):
    return r.lexicon(r.postings(v.base(spark, d, "documents"), "doc_id", "text")).where("df > 1").agg(F.count("*").alias("terms"), F.sum("df").alias("total"))


@query("r05_idf_rebalance", "WITH " + _TERMS + """, old AS (SELECT term, count(*) AS df FROM post WHERE id % 2 = 0 GROUP BY term), n0 AS (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 0)
  SELECT count(*) AS n, round(sum(weight * CASE WHEN greatest(0, ln((n0.n - old.df + 0.5) / (old.df + 0.5))) < 1e-9 THEN 1 ELSE greatest(0, ln((nn.n - lex.df + 0.5) / (lex.df + 0.5))) / greatest(0, ln((n0.n - old.df + 0.5) / (old.df + 0.5))) END), 3) AS total
  FROM wt JOIN old USING (term) JOIN lex USING (term), n0, nn""")
def r05(spark, d):
    docs = v.base(spark, d, "documents").select("doc_id", "text")
    posts = r.postings(docs, "doc_id", "text")
    new, old = r.lexicon(posts), r.lexicon(posts.where("id % 2 = 0"))
    n, half = docs.count(), docs.where("doc_id % 2 = 0").count()
    out = r.rebalanced(r.sparse_weights(posts, new, n), old, new, half, n)
    return out.agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("total"))


@query("s02_sparse_search", "WITH " + _SPARSE + " SELECT id, round(score, 6) AS score, rank::INTEGER AS rank FROM spr WHERE rank <= 20")
def s02(spark, d):
    return _sparse(spark, d, 20).select("id", F.round("score", 6).alias("score"), "rank")


@query("s02b_indexed_search", "WITH " + _SPARSE + " SELECT id, round(score, 6) AS score, rank::INTEGER AS rank FROM spr WHERE rank <= 20")
def s02b(spark, d):
    """The same search over an index that was appended in three segments."""
    return _sparse(spark, d, 20, 3).select("id", F.round("score", 6).alias("score"), "rank")


@query("s02c_sparse_filtered", "WITH " + _SPARSE + """, f AS (SELECT sp.id, sp.score FROM sp JOIN documents d ON d.doc_id = sp.id WHERE d.lang = 'en' AND sp.score >= 1.0)
  SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 20""")
def s02c(spark, d):
    """With a least score, among the documents of a filter."""
    among = v.base(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return indexes.sparse(spark, d).search(_asked(spark), 20, threshold=1.0, among=among).select("id", F.round("score", 6).alias("score"), "rank")


@query("s02d_sparse_batch", "WITH " + _TERMS + """, q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(list_transform(regexp_split_to_array(text, ' '), lambda x: lower(x)), lambda x: regexp_matches(x, '^[a-z]{4,}$'))) AS term FROM benchmark),
  sc AS (SELECT query_id, id, round(sum(weight), 9) AS score FROM wt JOIN q USING (term) GROUP BY query_id, id)
  SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 5""")
def s02d(spark, d):
    """Every item of the benchmark as a query of its words, in one search."""
    words = F.filter(F.transform(F.split("text", " "), F.lower), lambda x: x.rlike("^[a-z]{4,}$"))
    asked = v.base(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term")).distinct().withColumn("q", F.lit(1.0))
    return indexes.sparse(spark, d).search(asked, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("r02b_index_lexicon", "WITH " + _TERMS + " SELECT term, df FROM lex")
def r02b(spark, d):
    """Document frequencies out of the index."""
    return indexes.sparse(spark, d, 3).lexicon()


@query("r07_hybrid_rrf", "WITH " + _SPARSE + ", " + _DENSE + """, u AS (SELECT id, 1.0 / (60 + rank) AS s FROM spr WHERE rank <= 40 UNION ALL SELECT id, 0.7 / (60 + rank) FROM dnr WHERE rank <= 40), f AS (SELECT id, sum(s)::DOUBLE AS score FROM u GROUP BY id)
  SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 20""")
def r07(spark, d):
    return r.weighted_rrf([(_sparse(spark, d, 40), 1.0), (_dense(spark, d, 40), 0.7)], 20).select("id", F.round("score", 9).alias("score"), "rank")


@query("r08_front_fusion", "WITH " + _SPARSE + ", " + _DENSE + """, a AS (SELECT * FROM dnr WHERE rank <= 30), b AS (SELECT * FROM spr WHERE rank <= 30)
  SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN a.id IS NULL THEN 0.5 * 0.25 / (60 + b.rank) ELSE 1.0 / (60 + a.rank) + coalesce(0.25 / (60 + b.rank), 0) END, 9)::DOUBLE AS score FROM a FULL JOIN b ON a.id = b.id""")
def r08(spark, d):
    return r.front_rrf(_dense(spark, d, 30), _sparse(spark, d, 30)).select("id", F.round("score", 9).alias("score"))


@query("r09_query_leg_fusion", "WITH " + _DENSE + ", t AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM dn), u AS (SELECT id, 1.0 / (60 + rank) AS s FROM dnr WHERE rank <= 20 UNION ALL SELECT id, 0.9 / (60 + rank) FROM t WHERE rank <= 20) SELECT id, round(sum(s), 9)::DOUBLE AS score FROM u GROUP BY id ORDER BY sum(s) DESC, id LIMIT 10")
def r09(spark, d):
    return r.weighted_rrf([(_dense(spark, d, 20), 1.0), (_reverse(spark, d, 20), 0.9)], 10).select("id", F.round("score", 9).alias("score"))


def _reverse(spark, d, k):
    far = r.dense_search(v.points(spark, d), v.points(spark, d).where("id = 0").select(F.lit(0).alias("query_id"), F.transform("dense", lambda x: -x).alias("vector")), k)
    return far


@query("r10_best_rank_fusion", "WITH " + _DENSE + ", t AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM dn), u AS (SELECT id, rank, 0 AS leg FROM dnr WHERE rank <= 20 UNION ALL SELECT id, rank, 1 FROM t WHERE rank <= 20), m AS (SELECT id, min(rank * 2 + leg) AS b FROM u GROUP BY id) SELECT id, (b % 2)::INTEGER AS leg, round(1.0 / (b // 2), 9)::DOUBLE AS score, row_number() OVER (ORDER BY b, id)::INTEGER AS place FROM m")
def r10(spark, d):
    return r.best_rank(_dense(spark, d, 20), _reverse(spark, d, 20)).select("id", "leg", F.round("score", 9).alias("score"), "place")


@query("r11_tag_expansion", """WITH t AS (SELECT tag, max(score) AS s FROM {keywords} WHERE tag_type = 'concept' AND (tag LIKE '%ther%' OR tag LIKE '%tion%') GROUP BY tag ORDER BY s DESC, tag LIMIT 10),
  d AS (SELECT DISTINCT doc_id FROM keywords WHERE tag IN (SELECT tag FROM t)), k AS (SELECT tag, max(score) AS s FROM keywords WHERE doc_id IN (SELECT doc_id FROM d) AND tag NOT IN ('ther', 'tion') GROUP BY tag ORDER BY s DESC, tag LIMIT 10)
  SELECT tag AS term, 0.5::DOUBLE AS q FROM k UNION ALL SELECT 'ther', 1.0 UNION ALL SELECT 'tion', 1.0""")
def r11(spark, d):
    k = v.keywords(spark, d)
    asked = spark.createDataFrame([("ther", 1.0), ("tion", 1.0)], "term string, q double")
    tags = k.where("tag_type = 'concept' and (tag like '%ther%' or tag like '%tion%')").groupBy("tag").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "tag").limit(10)
    docs = k.join(F.broadcast(tags.select("tag")), "tag", "left_semi").select("doc_id").distinct()
    more = k.join(docs, "doc_id", "left_semi").join(F.broadcast(asked), F.col("tag") == F.col("term"), "left_anti").groupBy("tag").agg(F.max("score").alias("s"))
    more = more.orderBy(F.desc("s"), "tag").limit(10).select(F.col("tag").alias("term"), F.lit(0.5).alias("q"))
    return more.unionByName(asked)


_HITS = _DENSE + ", h AS (SELECT id, tenant_id, 0.9 - rank * 0.01 AS score, rank FROM dnr JOIN points USING (id) WHERE rank <= 60)"


def _hits(spark, d):
    """The 60 best hits of a dense search, with evenly spaced scores."""
    p = _dense(spark, d, 60).select("id", "rank").join(v.points(spark, d).select("id", "tenant_id"), "id")
    return p.select(F.lit(0).alias("query_id"), "id", F.col("tenant_id").alias("source"), (F.lit(0.9) - F.col("rank") * 0.01).alias("score"), "rank")


@query("r12_path_boost", "WITH q AS (SELECT file_id, list_filter(['fr', 'doc', 'pyx'], lambda x: list_contains(string_split_regex(lower(file_path), '[^a-z0-9]+'), x)) AS hit FROM {files}) SELECT file_id, round(1 + 0.8 * len(hit) / 3, 9)::DOUBLE AS score FROM q")
def r12(spark, d):
    rel = r.path_relevance(F.split(F.lower("file_path"), "[^a-z0-9]+"), F.array(F.lit("fr"), F.lit("doc"), F.lit("pyx")))
    return v.files(spark, d).select("file_id", F.round(r.boosted(F.lit(1.0), rel), 9).alias("score"))


@query("r13_intent_factor", "SELECT file_id, CASE WHEN file_path LIKE '%.py' THEN 1.12 ELSE 0.86 END::DOUBLE AS factor FROM {files}")
def r13(spark, d):
    return v.files(spark, d).select("file_id", r.intent_factor(F.col("file_path").endswith(".py"), "where is the function").cast("double").alias("factor"))


@query("r15_path_derank", "SELECT file_id, CASE WHEN contains(file_path, '/de/') OR contains(file_path, '.md') THEN 0.2 ELSE 1.0 END::DOUBLE AS score FROM {files}")
def r15(spark, d):
    return v.files(spark, d).select("file_id", r.deranked(F.lit(1.0), F.col("file_path"), ["/de/", ".md"]).alias("score"))


@query("r16_first_of_each_file", "WITH " + _HITS + " SELECT arg_min(id, rank) AS id, tenant_id AS source FROM h GROUP BY tenant_id")
def r16(spark, d):
    return r.first_of_each(_hits(spark, d), F.col("source")).select("id", "source")


@query("r17_same_bodies", "SELECT min(doc_id) AS id FROM documents WHERE length(trim(text)) >= 80 GROUP BY trim(text) UNION ALL SELECT doc_id FROM documents WHERE length(trim(text)) < 80")
def r17(spark, d):
    docs = v.base(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("rank"), F.lit(0).alias("query_id"))
    return r.without_same_bodies(docs, "text").select("id")


@query("r18_rerank_blend", "WITH " + _HITS + """, x AS (SELECT *, CASE WHEN id % 4 <> 0 THEN (id * 7) % 11 / 11.0 END AS rerank FROM h), p AS (SELECT *, rank <= 30 AND rerank IS NOT NULL AS i FROM x),
  b AS (SELECT *, CASE WHEN i THEN 0.9 * (score - min(score) OVER (PARTITION BY i)) / (max(score) OVER (PARTITION BY i) - min(score) OVER (PARTITION BY i)) + 0.1 * (rerank - min(rerank) OVER (PARTITION BY i)) / (max(rerank) OVER (PARTITION BY i) - min(rerank) OVER (PARTITION BY i)) END AS blend FROM p)
  SELECT id, round(blend, 6)::DOUBLE AS blend, row_number() OVER (ORDER BY i DESC, blend DESC NULLS LAST, rank)::INTEGER AS place FROM b""")
def r18(spark, d):
    h = _hits(spark, d).withColumn("rerank", F.when(F.col("id") % 4 != 0, (F.col("id") * 7) % 11 / 11.0))
    return r.rerank_blend(h).select("id", F.round("blend", 6).alias("blend"), "place")


@query("r20_scratchpad_lane", "WITH " + _HITS + " (SELECT id, 'main' AS lane FROM h WHERE rank <= 10) UNION ALL (SELECT id, 'scratchpad' FROM h WHERE rank > 10 AND id % 3 = 0 ORDER BY rank LIMIT 3)")
def r20(spark, d):
    h = _hits(spark, d)
    return h.where("rank <= 10").select("id", F.lit("main").alias("lane")).unionByName(h.where("rank > 10 and id % 3 = 0").orderBy("rank").limit(3).select("id", F.lit("scratchpad").alias("lane")))


@query("r21_distance_decay", "WITH " + _HITS + " SELECT id, round(score * CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END, 9)::DOUBLE AS score FROM h")
def r21(spark, d):
    return _hits(spark, d).select("id", F.round(r.decayed(F.col("score"), F.col("id") % 3), 9).alias("score"))


@query("r22_group_scope", "SELECT id FROM {points} WHERE tenant_id IN (SELECT 't' || k FROM range(0, 10) t(k) WHERE k % 3 = 1)")
def r22(spark, d):
    members = spark.createDataFrame([(f"t{k}",) for k in range(10) if k % 3 == 1], "tenant_id string")
    return v.points(spark, d).join(F.broadcast(members), "tenant_id", "left_semi").select("id")


@query("r23_source_diversity", "WITH RECURSIVE " + _HITS + """, t AS (SELECT rank, id, tenant_id, (0.9::DOUBLE - rank * 0.01::DOUBLE) AS score, 0 AS tier, (0.9::DOUBLE - rank * 0.01::DOUBLE) AS top FROM h WHERE rank = 1 UNION ALL SELECT h.rank, h.id, h.tenant_id, (0.9::DOUBLE - h.rank * 0.01::DOUBLE), t.tier + CASE WHEN t.top - (0.9::DOUBLE - h.rank * 0.01::DOUBLE) > 0.05::DOUBLE THEN 1 ELSE 0 END, CASE WHEN t.top - (0.9::DOUBLE - h.rank * 0.01::DOUBLE) > 0.05::DOUBLE THEN (0.9::DOUBLE - h.rank * 0.01::DOUBLE) ELSE t.top END FROM t JOIN h ON h.rank = t.rank + 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY tier, tenant_id ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY tier, tenant_id) AS f FROM t), c AS (SELECT *, row_number() OVER (ORDER BY tier, turn, f) AS seq FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS nth FROM c)
  SELECT id, tenant_id AS source, tier::INTEGER AS tier, row_number() OVER (ORDER BY seq)::INTEGER AS place FROM e WHERE nth <= 3""")
def r23(spark, d):
    return r.interleaved(r.score_tiers(_hits(spark, d))).select("id", "source", "tier", "place")


@query("w08_score_tiers", "WITH " + _HITS + " SELECT id, ((rank - 1) // 6)::INTEGER AS tier FROM h")
def w08(spark, d):
    return r.score_tiers(_hits(spark, d), 0.0549).select("id", "tier")


@query("w09_round_robin", "WITH " + _HITS + """, a AS (SELECT *, (rank - 1) // 6 AS tier FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY tier, tenant_id ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY tier, tenant_id) AS f FROM a),
  c AS (SELECT *, row_number() OVER (ORDER BY tier, turn, f) AS seq FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS nth FROM c)
  SELECT id, row_number() OVER (ORDER BY seq)::INTEGER AS place FROM e WHERE nth <= 3""")
def w09(spark, d):
    h = _hits(spark, d).withColumn("tier", F.floor((F.col("rank") - 1) / 6))
    return r.interleaved(h).select("id", "place")


@query("r24_diversity_score", "WITH " + _HITS + " SELECT round(count(DISTINCT tenant_id) / count(*), 9) AS diversity FROM h")
def r24(spark, d):
    return _hits(spark, d).agg(F.round(F.countDistinct("source") / F.count("*"), 9).alias("diversity"))


@query("w10_byte_budget", "WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS t FROM documents) SELECT doc_id FROM s WHERE t <= 24000 OR doc_id = 0")
def w10(spark, d):
    return r.first_within_budget(v.base(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 24_000, ["doc_id"]).select("doc_id")


@query("r25_shaped_payloads", "SELECT doc_id, left(text, 1500) AS body, length(text) > 1500 AS cut FROM documents")
def r25(spark, d):
    return v.base(spark, d, "documents").select("doc_id", F.left("text", F.lit(1500)).alias("body"), (F.length("text") > 1500).alias("cut"))


@query("r26_keyword_fallback", "SELECT doc_id AS id, 0.5::DOUBLE AS score FROM documents WHERE contains(lower(text), 'the and') ORDER BY doc_id LIMIT 30")
def r26(spark, d):
    return v.base(spark, d, "documents").where(F.lower("text").contains("the and")).select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score")).orderBy("id").limit(30)


@query("r27_duplicate_rules", "WITH " + _DENSE + " SELECT id, round(score, 6) AS score FROM dnr WHERE id <> 0 AND score >= 0.1 ORDER BY rank LIMIT 5")
def r27(spark, d):
    p = v.points(spark, d)
    return r.dense_search(p.where("id <> 0"), p.where("id = 0").select(F.lit(0).alias("query_id"), F.col("dense").alias("vector")), 5, 0.1).select("id", F.round("score", 6).alias("score"))


@query("r28_retrieve_by_location", "SELECT doc_id, (k * 1000) AS start FROM (SELECT doc_id, unnest(range(0, (length(text) + 999) // 1000)) AS k, text FROM documents) WHERE 2500 BETWEEN k * 1000 AND k * 1000 + 999")
def r28(spark, d):
    c = v.base(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") + 999) / 1000) - 1)).alias("k"), F.length("text").alias("n")).where("n > 0")
    return c.where("2500 between k * 1000 and k * 1000 + 999").select("doc_id", (F.col("k") * 1000).alias("start"))


_CENTRE = ", ".join(f"avg(dense[{k}])" for k in range(1, 65))


@query("r29_cross_modal_search", f"WITH q AS (SELECT [{_CENTRE}] AS c FROM {{points}} WHERE label = 3) SELECT id, round(list_dot_product(dense, c) / (sqrt(list_dot_product(dense, dense)) * sqrt(list_dot_product(c, c))), 6) AS score FROM points, q ORDER BY list_dot_product(dense, c) / (sqrt(list_dot_product(dense, dense)) * sqrt(list_dot_product(c, c))) DESC, id LIMIT 15")
def r29(spark, d):
    p = v.points(spark, d)
    centre = p.where("label = 3").agg(mean_vector("dense", dimensions(p, "dense")).alias("vector")).select(F.lit(0).alias("query_id"), "vector")
    return r.dense_search(p, centre, 15).select("id", F.round("score", 6).alias("score"))


@query("r19_symbol_lane", "WITH n AS (SELECT * FROM (VALUES ('sym_1', 0), ('sym_2', 1)) t(needle, i)), m AS (SELECT node_id, min(i) AS i FROM {graph_nodes} JOIN n ON contains(symbol_name, needle) GROUP BY node_id) SELECT node_id, round(1.2 - 0.001 * i, 6)::DOUBLE AS score FROM m")
def r19(spark, d):
    needles = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for i, s in enumerate(("sym_1", "sym_2"))])
    met = v.graph_nodes(spark, d).select("node_id", F.filter(needles, lambda x: F.col("symbol_name").contains(x["s"])).alias("m")).where("size(m) > 0")
    return met.select("node_id", F.round(1.2 - 0.001 * F.array_min(F.transform("m", lambda x: x["i"])), 6).alias("score"))


@query("r14_symbol_boost", "SELECT node_id, CASE WHEN list_has_all(['sym', '1', 'sup', '2'], string_split(lower(symbol_name), '_')) THEN 1.5 ELSE 1.0 END::DOUBLE AS factor FROM {graph_nodes}")
def r14(spark, d):
    asked = F.array(*map(F.lit, ("sym", "1", "sup", "2")))
    missing = F.array_except(F.split(F.lower("symbol_name"), "_"), asked)
    return v.graph_nodes(spark, d).select("node_id", F.when(F.size(missing) == 0, 1.5).otherwise(1.0).alias("factor"))


@query("s03_filtered_scroll", "SELECT id FROM {points} WHERE tenant_id = 't2' AND id > 40 ORDER BY id LIMIT 10")
def s03(spark, d):
    return r.after(v.points(spark, d).where(r.payload_filter({"tenant_id": "t2", "odd": 1.5})).select("id"), "id", 40, 10)


@query("s04_distinct_paths", "SELECT DISTINCT tenant_id, language FROM {files} WHERE tenant_id = 'src3'")
def s04(spark, d):
    return v.files(spark, d).where("tenant_id = 'src3'").select("tenant_id", "language").distinct()


@query("s05_counts_and_existence", "SELECT (SELECT count(*) FROM {points} WHERE tenant_id = 't1') AS n, (SELECT count(*) FROM points WHERE id IN (1, 2, 999999)) AS known")
def s05(spark, d):
    p = v.points(spark, d)
    return p.agg(F.count_if(F.col("tenant_id") == "t1").alias("n"), F.count_if(F.col("id").isin(1, 2, 999999)).alias("known"))


@query("s06_upsert_latest", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM {points}")
def s06(spark, d):
    p = v.points(spark, d).select("id", F.lit("old").alias("state"), F.lit(1).alias("version"))
    new = p.where("id % 3 = 0").select("id", F.lit("new").alias("state"), F.lit(2).alias("version"))
    return r.upserted(p, new, "id", "version").select("id", "state")


@query("s07_delete_by_filter", "SELECT id FROM {points} WHERE NOT (tenant_id = 't1' OR id IN (2, 4))")
def s07(spark, d):
    gone = spark.createDataFrame([(2,), (4,)], "id long")
    return v.points(spark, d).where("tenant_id <> 't1'").join(F.broadcast(gone), "id", "left_anti").select("id")


@query("s08_branch_sets", "SELECT file_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(branches, lambda x: x <> 'main'), ['dev', language]))), ',') AS branches FROM {files}")
def s08(spark, d):
    merged = F.array_union(F.array_except("branches", F.array(F.lit("main"))), F.array(F.lit("dev"), F.col("language")))
    return v.files(spark, d).select("file_id", F.array_join(F.array_sort(F.array_distinct(merged)), ",").alias("branches"))


@query("s11_file_listing", "SELECT file_path, max(size_bytes) AS size_bytes FROM {files} WHERE file_path > 'src1' GROUP BY file_path ORDER BY file_path LIMIT 25")
def s11(spark, d):
    return r.after(v.files(spark, d).groupBy("file_path").agg(F.max("size_bytes").alias("size_bytes")), "file_path", "src1", 25)


@query("s12_merge_two_stores", "SELECT file_id, 'tracked' AS origin FROM {files} WHERE file_id % 2 = 0 UNION ALL SELECT file_id, 'search' FROM files WHERE file_id % 3 = 0 AND file_id % 2 <> 0")
def s12(spark, d):
    f = v.files(spark, d).select("file_id")
    tracked = f.where("file_id % 2 = 0")
    return tracked.withColumn("origin", F.lit("tracked")).unionByName(f.where("file_id % 3 = 0").join(tracked, "file_id", "left_anti").withColumn("origin", F.lit("search")))


@query("s14_document_types", "SELECT file_id, CASE WHEN file_path LIKE '%.test.ts' THEN 'typescript' WHEN file_path LIKE '%.md' THEN 'markdown' WHEN file_path LIKE '%.py' THEN 'python' ELSE 'text' END AS kind FROM {files}")
def s14(spark, d):
    from siltstone.sources.readers import document_type

    return v.files(spark, d).select("file_id", document_type(F.col("file_path")).alias("kind"))


@query("s17_largest_files", "SELECT file_id, size_bytes FROM {files} ORDER BY size_bytes DESC NULLS LAST, file_id LIMIT 15")
def s17(spark, d):
    return v.files(spark, d).select("file_id", "size_bytes").orderBy(F.col("size_bytes").desc_nulls_last(), "file_id").limit(15)


@query("s17b_churn", "SELECT file_id, reindex_count, array_to_string(branches, ',') AS branches FROM {files} WHERE reindex_count >= 5 ORDER BY reindex_count DESC, file_id LIMIT 20")
def s17b(spark, d):
    return v.files(spark, d).where("reindex_count >= 5").select("file_id", "reindex_count", F.concat_ws(",", "branches").alias("branches")).orderBy(F.desc("reindex_count"), "file_id").limit(20)


@query("k02_paging", "WITH " + _HITS + " SELECT id, true AS has_more FROM h WHERE rank BETWEEN 11 AND 20")
def k02(spark, d):
    return r.page(_hits(spark, d), 10, 10, ["rank"]).select("id", "has_more")


@query("k07_result_refs", "WITH " + _HITS + " SELECT array_to_string(list(id || ':' || round(score, 3) ORDER BY rank), ',') AS refs FROM h WHERE rank <= 5")
def k07(spark, d):
    top = _hits(spark, d).where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("t"))
    return top.select(F.array_join(F.transform("t", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.round(x["score"], 3).cast("string"))), ",").alias("refs"))


@query("u04_merge_by_missing_path", "SELECT file_path FROM {files} WHERE tenant_id = 'src1' UNION SELECT file_path FROM files WHERE tenant_id = 'src2' AND file_path NOT IN (SELECT file_path FROM files WHERE tenant_id = 'src1')")
def u04(spark, d):
    f = v.files(spark, d)
    a = f.where("tenant_id = 'src1'").select("file_path")
    return a.unionByName(f.where("tenant_id = 'src2'").select("file_path").join(a, "file_path", "left_anti"))


@query("u05_jaccard_of_sets", "WITH s AS (SELECT tenant_id, list(DISTINCT tag) AS t FROM {keywords} GROUP BY tenant_id) SELECT a.tenant_id AS a, b.tenant_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 9) AS jaccard FROM s a JOIN s b ON a.tenant_id < b.tenant_id WHERE len(list_intersect(a.t, b.t)) > 0")
def u05(spark, d):
    from siltstone.operators.graphs import set_similarity

    return set_similarity(v.keywords(spark, d).select("tenant_id", "tag").distinct(), "tenant_id", "tag").select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("a21_document_vectors", "SELECT label, round(sum(dense[1] * (id % 3 + 1)) / sum(id % 3 + 1), 6) AS x1, round(sum(dense[64] * (id % 3 + 1)) / sum(id % 3 + 1), 6) AS x64 FROM {points} GROUP BY label")
def a21(spark, d):
    p = v.points(spark, d)
    m = p.groupBy("label").agg(mean_vector("dense", dimensions(p, "dense"), F.col("id") % 3 + 1).alias("m"))
    return m.select("label", F.round(F.element_at("m", 1), 6).alias("x1"), F.round(F.element_at("m", 64), 6).alias("x64"))


@query("m05_retrieval_quality", """WITH e AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7) % 13, id) AS rank FROM e),
  z AS (SELECT *, rank % 2 = 0 OR rank = 1 AS keep FROM k) SELECT query_id, max(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1, (count(*) FILTER (keep AND rank <= 10) / count(*))::DOUBLE AS recall, max(CASE WHEN keep THEN 1.0 / rank ELSE 0 END)::DOUBLE AS rr FROM z GROUP BY query_id""")
def m05(spark, d):
    e = r.containing(v.base(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), v.base(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("part")))
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy((F.col("id") * 7) % 13, "id"))).where("rank % 2 = 0 or rank = 1")
    return r.retrieval_quality(ranked, e).select("query_id", "top1", "recall", "rr")


@query("m06_quality_verdict", "SELECT language, round(avg(file_id % 2), 6) AS top3, round(avg(file_id % 3), 6) AS recall, CASE WHEN avg(file_id % 2) >= 0.8 AND avg(file_id % 3) >= 0.7 THEN 'good' WHEN avg(file_id % 2) >= 0.8 OR avg(file_id % 3) >= 0.7 THEN 'mixed' ELSE 'poor' END AS verdict FROM {files} GROUP BY language")
def m06(spark, d):
    s = v.files(spark, d).groupBy("language").agg(F.avg(F.col("file_id") % 2).alias("top3"), F.avg(F.col("file_id") % 3).alias("recall"))
    a, b = F.col("top3") >= 0.8, F.col("recall") >= 0.7
    return s.select("language", F.round("top3", 6).alias("top3"), F.round("recall", 6).alias("recall"), F.when(a & b, "good").when(a | b, "mixed").otherwise("poor").alias("verdict"))


@query("m07_category_breakdown", "SELECT string_split(file_path, '/')[2] AS category, count(*) AS n FROM {files} GROUP BY 1")
def m07(spark, d):
    return v.files(spark, d).groupBy(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("category")).agg(F.count("*").alias("n"))
