"""Queries of enrichment, catalogue and join operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as ft
from siltstone.functions.vectors import cosine, dimensions, mean_vector
from siltstone.operators import enrich as e
from siltstone.operators import retrieval as r
from siltstone.plans._registry import Registry
from siltstone.sources import views as v

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _docs(spark, d):
    return v.base(spark, d, "documents").select("doc_id", "text")


@query("e01_paragraph_chunks")
def e01(spark, d):
    return e.chunked(_docs(spark, d), "doc_id", "text", e.paragraph_chunks)


@query("e02_character_chunks")
def e02(spark, d):
    return e.chunked(_docs(spark, d), "doc_id", "text", e.character_chunks)


@query("e03_token_chunks", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 16), 112)) AS a FROM w WHERE len(w) > 0) SELECT doc_id, (a // 112)::INTEGER AS index, array_to_string(w[a + 1:a + 128], ' ') AS content FROM s")
def e03(spark, d):
    return e.chunked(_docs(spark, d), "doc_id", "text", e.token_chunks)


@query("e34_sliding_chunks", """WITH s AS (SELECT doc_id, text, unnest(range(0, CASE WHEN strlen(text) <= 1000 THEN 1 ELSE greatest(0, CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT)) + 1 END)) AS index FROM documents WHERE length(text) > 0)
  SELECT doc_id, index::INTEGER AS index, substr(text, index * 800 + 1, 1000) AS content FROM s WHERE trim(substr(text, index * 800 + 1, 1000)) <> ''""")
def e34(spark, d):
    return e.sliding_chunks(_docs(spark, d), "doc_id", "text")


@query("e05_chunker_fingerprints", "SELECT file_id, 'v2:' || language || ':' || substr(sha256('rules' || language), 1, 12) AS fingerprint, file_id % 3 = 0 AS stale FROM {files}")
def e05(spark, d):
    now = e.fingerprint("v2", F.col("language"), F.concat(F.lit("rules"), "language"))
    stored = F.when(F.col("file_id") % 3 == 0, F.lit("v1:old")).when(F.col("file_id") % 3 == 1, now)
    return v.files(spark, d).select("file_id", now.alias("fingerprint"), e.is_stale(stored, now).alias("stale"))


@query("e06_markdown_sections", r"""WITH l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split('intro' || chr(10) || '# A' || chr(10) || text || chr(10) || '## B' || chr(10) || 'tail', chr(10)) AS ls FROM documents)),
  g AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l), h AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS part, arg_min(x, i) AS first_ FROM g GROUP BY doc_id, k)
  SELECT doc_id, k::INTEGER AS index, CASE WHEN k > 0 THEN nullif(regexp_extract(first_, '^#{1,6} +(.*)', 1), '') END AS heading, regexp_replace(CASE WHEN k > 0 THEN regexp_replace(part, '^#{1,6} [^\n]*\n?', '') ELSE part END, '^\s+|\s+$', '', 'g') AS body FROM h WHERE trim(part) <> ''""")
def e06(spark, d):
    whole = F.concat(F.lit("intro\n# A\n"), "text", F.lit("\n## B\ntail"))
    return e.markdown_sections(_docs(spark, d).withColumn("text", whole), "doc_id", "text")


@query("e07_parent_units", "SELECT file_id, count(*) AS blocks, sum(length(content))::BIGINT AS chars FROM {lines} WHERE trim(content) <> '' GROUP BY file_id")
def e07(spark, d):
    return v.lines(spark, d).where(F.trim("content") != "").groupBy("file_id").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


@query("e08_cleaned_texts", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text || chr(9) || 'x' || chr(1) || '  y', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[^\S\n]+', ' ', 'g'), ' ') AS cleaned FROM documents")
def e08(spark, d):
    return _docs(spark, d).select("doc_id", ft.cleaned(F.concat("text", F.lit("\tx\x01  y"))).alias("cleaned"))


def _flat(x: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '')"


@query("e09_html_titles", "SELECT page_id, coalesce(" + ", ".join(_flat(f"regexp_extract(html, '{p}', 1)") for p in (r"(?is)<title[^>]*>(.*?)</title>", r"""(?is)<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']*)["'']""", r"(?is)<h1[^>]*>(.*?)</h1>")) + ") AS title FROM pages")
def e09(spark, d):
    return v.base(spark, d, "pages").select("page_id", ft.html_title(F.col("html")).alias("title"))


@query("e09b_plain_titles", r"WITH l AS (SELECT doc_id, trim(regexp_extract(text, '^\s*([^\n]*)', 1)) AS t FROM documents) SELECT doc_id, CASE WHEN t <> '' AND strlen(t) <= 200 AND NOT regexp_matches(t, '[.,;]$') AND regexp_matches(t, '\p{Lu}') THEN t END AS title FROM l")
def e09b(spark, d):
    return _docs(spark, d).select("doc_id", ft.plain_title(F.col("text")).alias("title"))


@query("e09c_document_titles", r"""WITH l AS (SELECT *, trim(regexp_extract(content, '^\s*([^\n]*)', 1)) AS t, CASE file_id % 4 WHEN 0 THEN 'Report ' || file_id WHEN 1 THEN 'Slide ' || file_id END AS m FROM {files}),
  x AS (SELECT *, CASE WHEN t <> '' AND strlen(t) <= 200 AND NOT regexp_matches(t, '[.,;]$') AND regexp_matches(t, '\p{Lu}') THEN t END AS c FROM l)
  SELECT file_id, coalesce(CASE WHEN file_id % 4 = 0 THEN m END, c, 'Doc ' || file_id || CASE WHEN file_id % 5 = 2 THEN '.test' ELSE '' END) AS title, CASE WHEN file_id % 4 = 0 THEN 'metadata' WHEN c IS NOT NULL THEN 'content' ELSE 'file name' END AS source FROM x""")
def e09c(spark, d):
    f = v.files(spark, d)
    meta = F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("Report "), F.col("file_id").cast("string"))).when(F.col("file_id") % 4 == 1, F.concat(F.lit("Slide "), F.col("file_id").cast("string")))
    title, source = ft.document_title(meta, F.col("content"), F.col("file_path"), F.lit("plain"))
    return f.select("file_id", title.alias("title"), source.alias("source"))


@query("e10_redaction", r"""WITH x AS (SELECT doc_id, doc_id % 2 = 0 AS settings, list_concat(['db_password: "s3cr3t-' || doc_id || 'x", # note', 'see https://me:pw' || doc_id || 'pw@host/x', 'id AKIA' || lpad(doc_id::VARCHAR, 16, '0') || ' end', '<token>tok' || doc_id || 'en</token>', 'secret: ${S}'], string_split(text, chr(10))) AS ls FROM documents),
  y AS (SELECT doc_id, list_transform(list_concat([CASE WHEN settings THEN 'db_password: "<redacted>", # note' ELSE ls[1] END, 'see https://me:<redacted>@host/x', 'id <redacted> end', CASE WHEN settings THEN '<token><redacted></token>' ELSE ls[4] END, 'secret: ${S}'], ls[6:]),
    lambda l: CASE WHEN settings AND regexp_matches(l, '(?i)^\s*[\w.-]*token = ".{7,}') THEN regexp_replace(regexp_replace(l, '(?i)^(\s*[\w.-]*token = )"[^"]*"\s*([,;]?)\s*$', '\1"<redacted>"\2'), '(?i)^(\s*[\w.-]*token = )"[^"]*" .*?([,;]?)\s*$', '\1<redacted>\2') ELSE l END) AS ls FROM x)
  SELECT doc_id, array_to_string(ls, chr(10)) AS redacted FROM y""")
def e10(spark, d):
    """Settings and other files in turn, each with secrets of several kinds before its own text."""
    n = F.col("doc_id").cast("string")
    head = F.concat(F.lit('db_password: "s3cr3t-'), n, F.lit('x", # note\nsee https://me:pw'), n, F.lit("pw@host/x\nid AKIA"), F.lpad(n, 16, "0"), F.lit(" end\n<token>tok"), n, F.lit("en</token>\nsecret: ${S}\n"))
    path = F.when(F.col("doc_id") % 2 == 0, "app/conf.yaml").otherwise("lang/conf.yaml")
    return _docs(spark, d).select("doc_id", ft.redacted(F.concat(head, "text"), ft.holds_settings(path)).alias("redacted"))


@query("e11_lexical_candidates", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}0-9_]+'), lambda x: length(x) >= 3) AS w FROM documents),
  g AS (SELECT doc_id, w[i + 1] AS phrase, 1 AS n FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w) UNION ALL SELECT doc_id, w[i + 1] || ' ' || w[i + 2], 2 FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM w WHERE len(w) > 1)
    UNION ALL SELECT doc_id, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3], 3 FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
  c AS (SELECT doc_id, phrase, n, count(*) AS tf, 1 + ln(count(*)) AS score FROM g GROUP BY ALL) SELECT doc_id, phrase, tf, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, phrase COLLATE "C")::INTEGER AS rank FROM c QUALIFY rank <= 200""".replace(' COLLATE "C"', ""))
def e11(spark, d):
    return e.lexical_candidates(_docs(spark, d), "doc_id", "text").select("doc_id", "phrase", "tf", F.round("score", 6).alias("score"), "rank")


@query("e12_semantic_rerank", "SELECT id, round(0.6 * s + 0.4 * (id % 10) / 10.0, 6)::DOUBLE AS score FROM (SELECT p.id, list_dot_product(p.dense, q.dense) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(q.dense, q.dense))) AS s FROM {points} p, (SELECT dense FROM points WHERE id = 3) q) WHERE s >= 0.15")
def e12(spark, d):
    p = v.points(spark, d)
    q = p.where("id = 3").select(F.lit(0).alias("query_id"), F.col("dense").alias("vector"))
    near = r.similarities(p, q)
    return near.select("id", F.round(e.semantic_rerank((F.col("id") % 10) / 10.0, F.col("score")), 6).alias("score")).where("score is not null")


@query("e13_keyword_selection", """WITH k AS (SELECT doc_id, tag AS phrase, max(score) AS score FROM {keywords} GROUP BY ALL), f AS (SELECT phrase, count(*) AS df FROM k GROUP BY phrase), n AS (SELECT count(DISTINCT doc_id) AS n FROM k),
  s AS (SELECT doc_id, phrase, score * (ln((n + 1) / (df + 1)) + 1) AS ks FROM k JOIN f USING (phrase), n WHERE df <= 0.8 * n) SELECT doc_id, phrase, round(ks, 6) AS keyword_score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ks DESC, phrase) <= 10""")
def e13(spark, d):
    k = v.keywords(spark, d).groupBy("doc_id", F.col("tag").alias("phrase")).agg(F.max("score").alias("score"))
    n = k.select("doc_id").distinct().count()
    s = e.selected_keywords(k, k.groupBy("phrase").agg(F.count("*").alias("df")), n, "doc_id", 10)
    return s.select("doc_id", "phrase", F.round("keyword_score", 6).alias("keyword_score"))


def _tagged(spark, d):
    p = v.points(spark, d)
    return p.select(F.col("tenant_id").alias("tenant"), F.concat(F.lit("tag"), F.col("id").cast("string")).alias("tag"), ((F.col("id") * 7) % 13).alias("documents"), (((F.col("id") * 7) % 13) / 13.0).alias("score"), F.col("dense").alias("vector"))


@query("e14_diverse_tags")
def e14(spark, d):
    return e.diverse_tags(_tagged(spark, d), "tenant").select("tenant", "tag", "place", F.round("diversity", 6).alias("diversity"))


_MEANS = "m AS (SELECT label, [" + ", ".join(f"avg(dense[{k}])" for k in range(1, 65)) + "] AS c FROM {points} GROUP BY label)"
_NEAR = _MEANS + ", s AS (SELECT p.id, m.label, 'tag' || m.label AS tag, list_dot_product(p.dense, m.c) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(m.c, m.c))) AS s FROM points p, m)"


def _label_means(spark, d):
    p = v.points(spark, d)
    return p.groupBy("label").agg(mean_vector("dense", dimensions(p, "dense")).alias("c")).withColumn("tag", F.concat(F.lit("tag"), F.col("label").cast("string")))


@query("e15_basket_assignment", "WITH " + _NEAR + " SELECT id AS keyword, CASE WHEN s >= 0.2 THEN tag ELSE 'misc' END AS basket, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, tag) = 1")
def e15(spark, d):
    tags = _label_means(spark, d).select("tag", F.col("c").alias("tag_vector"))
    b = e.basket_of(v.points(spark, d).select(F.col("id").alias("keyword"), F.col("dense").alias("vector")), tags, 0.2)
    return b.select("keyword", "basket", F.round("similarity", 6).alias("similarity"))


@query("e16_canonical_merge")
def e16(spark, d):
    return e.merged_tags(_tagged(spark, d), "tenant", 0.2)


@query("e17_tag_hierarchy")
def e17(spark, d):
    return e.tag_levels(_tagged(spark, d), "tenant", 0.15, 0.05)


@query("e19_gist", """WITH u AS (SELECT label, id, list_transform(dense, lambda x: x / sqrt(list_dot_product(dense, dense))) AS u FROM {points}), c AS (SELECT a.label, a.id, avg(list_dot_product(a.u, b.u)) AS c FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id GROUP BY a.label, a.id)
  SELECT label, id, round(c, 6) AS centrality, row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, id)::INTEGER AS place FROM c QUALIFY place <= 3""")
def e19(spark, d):
    return e.gist(v.points(spark, d), "label", "id", "dense").select("label", "id", F.round("centrality", 6).alias("centrality"), "place")


@query("e19b_code_gist", r"""WITH c AS (SELECT file_id, line_number, list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda x: length(x) >= 2) AS w FROM {lines}), n AS (SELECT file_id, count(*) AS n, avg(len(w)) AS m FROM c GROUP BY file_id),
  t AS (SELECT file_id, line_number, len(w) AS l, unnest(w) AS t FROM c), f AS (SELECT file_id, line_number, l, t, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY file_id, t) AS df FROM f),
  s AS (SELECT file_id, line_number, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS s FROM d JOIN n USING (file_id) GROUP BY ALL)
  SELECT c.file_id, c.line_number, round(greatest(coalesce(s, 0), 0.01), 6)::DOUBLE AS weight FROM c LEFT JOIN s USING (file_id, line_number)""")
def e19b(spark, d):
    tokens = F.filter(F.split(F.lower("content"), "[^a-z]+"), lambda x: F.length(x) >= 2)
    chunks = v.lines(spark, d).withColumn("tokens", tokens).withColumn("vector", F.array(F.lit(1.0)))
    return e.term_weights(chunks, "file_id", "line_number", "vector", "tokens").select("file_id", "line_number", F.round("weight", 6).alias("weight"))


@query("e19c_summary_vectors", "WITH u AS (SELECT label, id, dense, list_transform(dense, lambda x: x / sqrt(list_dot_product(dense, dense))) AS u FROM {points}), c AS (SELECT a.label, a.id, greatest(0.01, avg(list_dot_product(a.u, b.u))) AS c FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id GROUP BY a.label, a.id) SELECT u.label, round(sum(dense[1] * c) / sum(c), 6) AS x1, round(sum(dense[len(dense)] * c) / sum(c), 6) AS x_last FROM u JOIN c USING (label, id) GROUP BY u.label")
def e19c(spark, d):
    s = e.summary_vector(v.points(spark, d), "label", "id", "dense")
    return s.select("label", F.round(F.get("vector", F.lit(0)), 6).alias("x1"), F.round(F.element_at("vector", -1), 6).alias("x_last"))


@query("e20_structural_tags", "SELECT file_id, array_to_string(list_sort(list_concat(['language:' || language], CASE WHEN contains(lower(file_path), '.md') THEN ['layer:docs'] ELSE [] END)), ',') AS tags FROM {files}")
def e20(spark, d):
    return v.files(spark, d).select("file_id", F.array_join(e.structural_tags(F.col("file_path"), F.col("language")), ",").alias("tags"))


@query("e21_merged_candidates", "WITH a AS (SELECT doc_id, upper(tag) AS phrase, 1.5::DOUBLE AS score FROM {keywords} WHERE length(tag) >= 9 GROUP BY ALL), b AS (SELECT doc_id, tag AS phrase, max(score) AS score FROM keywords GROUP BY ALL) SELECT * FROM a UNION ALL SELECT * FROM b WHERE (doc_id, phrase) NOT IN (SELECT doc_id, lower(phrase) FROM a)")
def e21(spark, d):
    k = v.keywords(spark, d)
    a = k.where("length(tag) >= 9").select("doc_id", F.upper("tag").alias("phrase"), F.lit(1.5).alias("score")).distinct()
    return e.merged_candidates(a, k.groupBy("doc_id", F.col("tag").alias("phrase")).agg(F.max("score").alias("score")), "doc_id")


@query("e22_path_tags", "SELECT file_id, tenant_id || ',' || language AS tags FROM {files}")
def e22(spark, d):
    return v.files(spark, d).select("file_id", F.array_join(e.path_tags(F.col("file_path")), ",").alias("tags"))


@query("e23_dependency_names", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'cargo' WHEN 1 THEN 'npm' WHEN 2 THEN 'pip' ELSE 'go' END AS kind,
  CASE doc_id % 4 WHEN 0 THEN 'serde-' || lang || ',tokio' WHEN 1 THEN '@a/' || lang || ',react' WHEN 2 THEN 'numpy,pandas-' || lang ELSE 'github.com/a/' || lang END AS names FROM documents""")
def e23(spark, d):
    """Manifests of each kind, made from a document's language."""
    docs = v.base(spark, d, "documents").select("doc_id", "lang")
    made = {
        "cargo": F.concat(F.lit("serde-"), "lang", F.lit(' = "1.0"\ntokio = { version = "1" }\n[x]')), "npm": F.concat(F.lit('{"react": "^18.0", "@a/'), "lang", F.lit('": "1.2"}')),
        "pip": F.concat(F.lit("numpy>=1.0\npandas-"), "lang", F.lit("\n# x")), "go": F.concat(F.lit("require github.com/a/"), "lang", F.lit(" v1.2.3")),
    }
    out = None
    for k, (kind, text) in enumerate(made.items()):
        rows = docs.where(F.col("doc_id") % 4 == k).select("doc_id", F.lit(kind).alias("kind"), F.array_join(e.dependency_names(text, kind), ",").alias("names"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("e24_taxonomy", "WITH " + _NEAR + """, f AS (SELECT *, max(s) OVER (PARTITION BY id, label % 3) AS b, row_number() OVER (PARTITION BY id, label % 3 ORDER BY s DESC, tag) AS r FROM s WHERE s >= 0.1)
  SELECT id, tag AS term, round(s, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, tag)::INTEGER AS place FROM f WHERE r = 1 OR b - s > 0.06 QUALIFY place <= 10""")
def e24(spark, d):
    terms = _label_means(spark, d).select(F.col("tag").alias("term"), (F.col("label") % 3).cast("string").alias("category"), F.col("c").alias("term_vector"))
    m = e.taxonomy_matches(v.points(spark, d).select("id", F.col("dense").alias("vector")), terms, 0.1)
    return m.select("id", "term", F.round("similarity", 6).alias("similarity"), "place")


@query("e26_enrichment_pipeline")
def e26(spark, d):
    f = v.files(spark, d).select(F.col("file_id").alias("doc_id"), F.col("content").alias("text"), F.col("file_path").alias("path"), "language")
    return e.enriched(f, _letters)


@query("e27_components", "SELECT file_id, CASE WHEN tenant_id = 'src1' AND language = 'de' THEN 'src1.de' ELSE tenant_id END AS component FROM {files} WHERE tenant_id IN ('src1', 'src2')")
def e27(spark, d):
    c = spark.createDataFrame([("src1",), ("src1/de",), ("src2",)], "base string")
    return e.assigned_components(v.files(spark, d), c)


@query("e28_metadata", "SELECT file_id, file_path, language, size_bytes, CASE WHEN tenant_id = 'src0' THEN 'libraries' ELSE 'projects' END AS collection FROM {files}")
def e28(spark, d):
    return v.files(spark, d).select("file_id", "file_path", "language", "size_bytes", F.when(F.col("tenant_id") == "src0", "libraries").otherwise("projects").alias("collection"))


@query("e29_format_routing", "SELECT file_id, CASE WHEN file_path LIKE '%.md' OR file_path LIKE '%.py' OR file_path LIKE '%.ts' OR file_path LIKE '%.txt' THEN tenant_id END AS place FROM {files}")
def e29(spark, d):
    return v.files(spark, d).select("file_id", e.routed(F.col("file_path"), F.col("tenant_id")).alias("place"))


def _model(texts):
    import numpy as np

    return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], float)


def _letters(texts):
    """A stand-in for a text model: how often a text has each letter."""
    import numpy as np

    raw = [x.lower().encode() for x in texts]
    letter = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) - ord("a")
    of = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    own = (letter >= 0) & (letter < 26)
    return np.bincount(of[own] * 26 + letter[own], minlength=26 * len(raw)).reshape(-1, 26).astype(float)


@query("e30_embedding_hook", "SELECT doc_id, [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))]::DOUBLE[] AS vector FROM documents")
def e30(spark, d):
    return e.embedded(_docs(spark, d), "text", _model).select("doc_id", "vector")


@query("e31_identities", "SELECT file_id, sha256(tenant_id || '|' || file_path) AS document_id, sha256(sha256(tenant_id || '|' || file_path) || '|3') AS chunk_id FROM {files}")
def e31(spark, d):
    doc = e.document_id(F.col("tenant_id"), F.col("file_path"))
    return v.files(spark, d).select("file_id", doc.alias("document_id"), e.chunk_id(doc, F.lit(3)).alias("chunk_id"))


@query("e32_branch_dedupe", "SELECT file_hash, count(*) AS copies, array_to_string(list_sort(list_distinct(flatten(list(branches)))), ',') AS branches FROM {files} GROUP BY file_hash")
def e32(spark, d):
    f = v.files(spark, d).select("file_hash", "file_id", F.explode("branches").alias("b"))
    return f.groupBy("file_hash").agg(F.countDistinct("file_id").alias("copies"), F.array_join(F.array_sort(F.collect_set("b")), ",").alias("branches"))


@query("e33_uplift_candidates", "SELECT file_id, unnest(branches) AS branch FROM {files} WHERE size_bytes IS NULL")
def e33(spark, d):
    return v.files(spark, d).where("size_bytes is null").select("file_id", F.explode("branches").alias("branch"))


@query("a23_tag_votes", "WITH n AS (SELECT tenant_id, count(DISTINCT doc_id) AS n FROM {keywords} GROUP BY 1), c AS (SELECT tenant_id, tag, count(DISTINCT doc_id) AS c FROM keywords GROUP BY ALL) SELECT tenant_id, tag, round(c / n, 9) AS score FROM c JOIN n USING (tenant_id) QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY c / n DESC, tag) <= 5")
def a23(spark, d):
    k = v.keywords(spark, d).groupBy("tenant_id", "doc_id").agg(F.collect_list("tag").alias("tags"))
    return e.tag_votes(k, "tenant_id", "tags", 5).select("tenant_id", "tag", F.round("score", 9).alias("score"))


@query("a24_folder_tree", "SELECT tenant_id AS folder, count(*) AS files FROM {files} GROUP BY 1 UNION ALL SELECT tenant_id || '/' || language, count(*) FROM files GROUP BY 1")
def a24(spark, d):
    return e.folder_tree(v.files(spark, d), "file_path").select("folder", "files")


@query("a25_branch_counts", "SELECT b AS branch, count(DISTINCT file_id) AS files FROM (SELECT file_id, unnest(branches) AS b FROM {files}) GROUP BY b")
def a25(spark, d):
    return v.files(spark, d).select("file_id", F.explode("branches").alias("branch")).groupBy("branch").agg(F.countDistinct("file_id").alias("files"))


@query("d01_document_and_line_counts", "WITH l AS (SELECT file_id, count(*) AS n FROM {lines} GROUP BY 1) SELECT tenant_id, count(*) AS files, sum(coalesce(n, 0))::BIGINT AS lines FROM {files} LEFT JOIN l USING (file_id) GROUP BY tenant_id")
def d01(spark, d):
    n = v.lines(spark, d).groupBy("file_id").agg(F.count("*").alias("n"))
    return v.files(spark, d).select("file_id", "tenant_id").join(n, "file_id", "left").groupBy("tenant_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))


@query("d02_languages", "SELECT language, count(*) AS n FROM {files} WHERE tenant_id = 'src2' GROUP BY language HAVING count(*) >= 1")
def d02(spark, d):
    return v.files(spark, d).where("tenant_id = 'src2'").groupBy("language").agg(F.count("*").alias("n")).where("n >= 1")


@query("d03_reconcile_reasons", "SELECT CASE WHEN size_bytes IS NULL THEN 'no size' WHEN reindex_count > 4 THEN 'churn' ELSE 'fine' END AS reason, count(*) AS n FROM {files} GROUP BY 1")
def d03(spark, d):
    reason = F.when(F.col("size_bytes").isNull(), "no size").when(F.col("reindex_count") > 4, "churn").otherwise("fine")
    return v.files(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("d04_projects", "SELECT tenant_id, count(DISTINCT language) AS languages FROM {files} WHERE reindex_count < 6 GROUP BY tenant_id")
def d04(spark, d):
    return v.files(spark, d).where("reindex_count < 6").groupBy("tenant_id").agg(F.countDistinct("language").alias("languages"))


@query("d07_tags_of_a_document", "SELECT tag, max(score) AS score FROM {keywords} WHERE doc_id = 7 GROUP BY tag")
def d07(spark, d):
    return v.keywords(spark, d).where("doc_id = 7").groupBy("tag").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "tag")


@query("d08_tag_search", "SELECT tag, count(DISTINCT doc_id) AS docs, round(avg(score), 6) AS avg_score FROM {keywords} WHERE tag LIKE '%tion%' GROUP BY tag ORDER BY docs DESC, tag LIMIT 50")
def d08(spark, d):
    return v.keywords(spark, d).where("tag like '%tion%'").groupBy("tag").agg(F.countDistinct("doc_id").alias("docs"), F.round(F.avg("score"), 6).alias("avg_score")).orderBy(F.desc("docs"), "tag").limit(50)


@query("d09_tag_statistics", "SELECT tenant_id, count(DISTINCT tag) AS tags, count(DISTINCT doc_id) AS docs, count(*) AS uses, count(*) FILTER (tag_type = 'concept') AS concepts, round(avg(score), 6) AS avg_score FROM {keywords} GROUP BY tenant_id")
def d09(spark, d):
    return v.keywords(spark, d).groupBy("tenant_id").agg(F.countDistinct("tag").alias("tags"), F.countDistinct("doc_id").alias("docs"), F.count("*").alias("uses"), F.count_if(F.col("tag_type") == "concept").alias("concepts"), F.round(F.avg("score"), 6).alias("avg_score"))


@query("d10_tag_tree", "SELECT r_name || '/' || n_name AS path, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 1 FROM region")
def d10(spark, d):
    reg, nat = v.base(spark, d, "region"), v.base(spark, d, "nation")
    roots = reg.select(F.col("r_name").alias("path"), F.lit(1).alias("level"))
    return roots.unionByName(nat.join(reg, nat.n_regionkey == reg.r_regionkey).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit(2).alias("level")))


@query("j03_tag_hierarchy", "SELECT n.n_name AS name, r.r_name AS parent, count(c.c_custkey) AS children FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL")
def j03(spark, d):
    n, reg, c = (v.base(spark, d, t) for t in ("nation", "region", "customer"))
    kids = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("children"))
    x = n.join(reg, n.n_regionkey == reg.r_regionkey, "left").join(kids, "n_nationkey", "left")
    return x.select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.coalesce("children", F.lit(0)).alias("children"))


@query("j08_id_list_join", "SELECT queue_id, status FROM {queue} WHERE queue_id IN (1, 2, 3, 32, 33)")
def j08(spark, d):
    ids = spark.createDataFrame([([1, 2, 3, 32, 33],)], "ids array<long>").select(F.explode("ids").alias("queue_id"))
    return v.queue(spark, d).join(F.broadcast(ids), "queue_id").select("queue_id", "status")


@query("j09_lateral_unnest", "SELECT b AS branch, count(*) AS n, min(file_id) AS first_file FROM (SELECT file_id, unnest(branches) AS b FROM {files}) GROUP BY b")
def j09(spark, d):
    return v.files(spark, d).select("file_id", F.explode("branches").alias("branch")).groupBy("branch").agg(F.count("*").alias("n"), F.min("file_id").alias("first_file"))


@query("j11_parent_lookup", "SELECT p.page_id AS id, p.page_id // 5 AS parent, q.url AS parent_url FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id // 5")
def j11(spark, d):
    p = v.base(spark, d, "pages").select(F.col("page_id").alias("id"), F.floor(F.col("page_id") / 5).alias("parent"))
    return p.join(v.base(spark, d, "pages").select(F.col("page_id").alias("parent"), F.col("url").alias("parent_url")), "parent", "left").select("id", "parent", "parent_url")


@query("j04_semi_join", "SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j04(spark, d):
    big = v.base(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return v.base(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("j05_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j05(spark, d):
    return v.base(spark, d, "customer").join(v.base(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j10_affinity_pairs", "WITH " + _MEANS + " SELECT a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))), 6) AS similarity FROM m a JOIN m b ON a.label < b.label WHERE list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))) >= 0.05")
def j10(spark, d):
    p = e.similar_pairs(_label_means(spark, d), "label", "c", 0.05)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("d12_primary_branch", "WITH c AS (SELECT tenant_id, language, count(*) AS n FROM {files} GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY tenant_id) AS mx FROM c) SELECT tenant_id, language FROM m QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY (language = 'fr' AND 2 * n >= mx) DESC, n DESC, language) = 1")
def d12(spark, d):
    c = v.files(spark, d).groupBy("tenant_id", "language").agg(F.count("*").alias("n"))
    w = W.partitionBy("tenant_id")
    c = c.withColumn("mx", F.max("n").over(w)).withColumn("head", (F.col("language") == "fr") & (2 * F.col("n") >= F.col("mx")))
    return c.withColumn("r", F.row_number().over(w.orderBy(F.desc("head"), F.desc("n"), "language"))).where("r = 1").select("tenant_id", "language")


@query("d13_missing_everywhere", "WITH b AS (SELECT file_id, unnest(branches) AS b FROM {files}) SELECT file_id FROM b GROUP BY file_id HAVING bool_and((file_id + length(b)) % 3 = 0)")
def d13(spark, d):
    b = v.files(spark, d).select("file_id", F.explode("branches").alias("b"))
    return b.groupBy("file_id").agg(F.every((F.col("file_id") + F.length("b")) % 3 == 0).alias("gone")).where("gone").select("file_id")


@query("d14_keyset_batch", "SELECT DISTINCT file_id FROM {lines} WHERE file_id > 50 ORDER BY file_id LIMIT 20")
def d14(spark, d):
    return r.after(v.lines(spark, d).select("file_id").distinct(), "file_id", 50, 20)


@query("d16_branch_coverage", "SELECT language, count(*) FILTER (file_id % 3 = 0) AS changed, count(*) FILTER (file_id % 3 = 0 AND size_bytes IS NOT NULL) AS covered FROM {files} GROUP BY language")
def d16(spark, d):
    changed = F.col("file_id") % 3 == 0
    return v.files(spark, d).groupBy("language").agg(F.count_if(changed).alias("changed"), F.count_if(changed & F.col("size_bytes").isNotNull()).alias("covered"))


@query("d18_coverage_audit", "SELECT tenant_id, CASE WHEN size_bytes IS NULL THEN 'empty' WHEN size_bytes > 5000 THEN 'too large' ELSE 'not indexed' END AS reason, count(*) AS n FROM {files} WHERE file_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def d18(spark, d):
    seen = v.base(spark, d, "labels").select(F.col("doc_id").alias("file_id"))
    reason = F.when(F.col("size_bytes").isNull(), "empty").when(F.col("size_bytes") > 5000, "too large").otherwise("not indexed")
    return v.files(spark, d).join(seen, "file_id", "left_anti").groupBy("tenant_id", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("d19_branch_grid", "SELECT tenant_id, coalesce(b, '(none)') AS branch, count(*) AS n FROM (SELECT tenant_id, CASE WHEN file_id % 4 = 0 THEN NULL ELSE language END AS b FROM {files}) GROUP BY ALL")
def d19(spark, d):
    b = F.when(F.col("file_id") % 4 != 0, F.array("language")).otherwise(F.array().cast("array<string>"))
    x = v.files(spark, d).select("tenant_id", F.explode_outer(b).alias("b"))
    return x.groupBy("tenant_id", F.coalesce("b", F.lit("(none)")).alias("branch")).agg(F.count("*").alias("n"))


@query("d24_base_points", "SELECT tenant_id, count(DISTINCT file_hash) AS base_points FROM {files} GROUP BY tenant_id")
def d24(spark, d):
    return v.files(spark, d).groupBy("tenant_id").agg(F.countDistinct("file_hash").alias("base_points"))


@query("r01_terms", "SELECT doc_id, 'file,http,in,my,my_file,parse,parsehttprequest' || lang || ',request' || lang || ',v1' AS terms FROM documents")
def r01(spark, d):
    """Terms of an identifier made from each document's language, beside marks, numbers, paths and hashes that are none."""
    text = F.concat(F.lit("parseHTTPRequest"), "lang", F.lit(" in my_file deadbeef99 v1.2 a/b 0xff 42 -"))
    docs = v.base(spark, d, "documents").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.array_join(F.array_sort(F.array_distinct(ft.terms(F.col("text")))), ",").alias("terms"))
