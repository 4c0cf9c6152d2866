"""The data model over the base tables: files, lines, points, events, timings, queue, metrics, tags and graphs.

Each view is a function (spark, dir) -> DataFrame. SQL has the same views as text, for the SQL twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.store import spread_by


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the base tables; texts are spread if they lie in fewer splits than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer than half as many splits, as one small file with one row group does; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("tenant_id"),
        F.array(F.col("lang"), F.lit("main")).alias("branches"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".md").when(F.col("doc_id") % 5 == 1, ".py").when(F.col("doc_id") % 5 == 2, ".test.ts").otherwise(".txt")).alias("file_path"),
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("size_bytes"),
        (F.col("doc_id") % 7).alias("reindex_count"),
        F.col("lang").alias("language"),
        F.sha2("text", 256).alias("file_hash"),
        F.col("text").alias("content"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files, numbered from 1."""
    d = base(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "content")).select("file_id", (F.col("p") + 1).alias("line_number"), "content")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("tenant_id"), F.col("embedding").cast("array<double>").alias("dense"), F.col("label"))


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")
    kind = F.col("event_type")
    i = F.col("event_id")
    return e.select(
        i.alias("id"),
        "ts",
        F.col("user_id").alias("session_id"),
        F.when(kind == "view", "search").when(kind == "click", "open").when(kind == "error", "grep").when(kind == "signup", "expand").otherwise("retrieve").alias("tool"),
        F.when(i % 3 == 0, "search").when(i % 3 == 1, "followup").otherwise("open").alias("op"),
        F.when(i % 2 == 0, "agent").otherwise("user").alias("actor"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project_id"),
        F.concat(F.lit("query "), (i % 40).cast("string"), F.lit(" "), kind).alias("query_text"),
        (F.get_json_object("props", "$.k").cast("long") % 5).alias("result_count"),
        F.round("value").cast("long").alias("latency_ms"),
        F.when(i % 6 == 0, i - 6).alias("parent_event_id"),
        F.when(i % 4 != 0, F.round(F.col("value") * 40).cast("long")).alias("bytes_in"),
        F.round(F.col("value") * 10).cast("long").alias("bytes_out"),
        F.when(i % 8 == 0, "lost").when(i % 8 == 1, "lost").otherwise("found").alias("resolution"),
        "value",
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("queue_id"), F.col("l_returnflag").alias("op"), F.col("l_linestatus").alias("phase"), F.col("l_quantity").cast("long").alias("duration_ms"), F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string")).alias("tenant_id"), F.col("l_shipdate").alias("created_at"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("queue_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"),
        F.when(k % 4 == 0, "file").when(k % 4 == 1, "folder").when(k % 4 == 2, "tenant").otherwise("url").alias("item_type"),
        F.when(k % 3 == 0, "add").when(k % 3 == 1, "update").otherwise("delete").alias("op"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("tenant_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        (k % 5).alias("retry_count"),
        F.when(k % 6 == 0, F.lit("connection refused")).when(k % 6 == 1, F.lit("file not found")).alias("error_message"),
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tag, score, tag_type from the words of documents."""
    d = base(spark, sf_dir, "documents")
    w = F.split(F.lower("text"), "[^a-z]+")
    x = d.select("doc_id", F.col("source").alias("tenant_id"), F.posexplode(w).alias("pos", "tag")).where(F.length("tag") >= 4)
    return x.select("doc_id", "tenant_id", "tag", F.when(F.length("tag") >= 6, "concept").otherwise("structural").alias("tag_type"), (1.0 / (F.col("pos") + 1)).alias("score"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers and nations as symbols."""
    p, s, n = (base(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    a = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.concat(F.lit("sym_"), (F.col("p_partkey") % 50).cast("string")).alias("symbol_name"), F.lit("function").alias("symbol_type"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".py")).alias("file_path"), (F.col("p_partkey") % 9 == 0).alias("is_test"))
    b = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")), F.lit("class"), F.concat(F.lit("lib/"), F.col("s_nationkey").cast("string"), F.lit(".py")), F.lit(False))
    c = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.lit("module"), F.lit("lib/all.py"), F.lit(False))
    return a.union(b).union(c)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier (CALLS), supplier -> nation (USES_TYPE), part -> part of an order's next line (REFERENCES)."""
    li = base(spark, sf_dir, "lineitem")
    weight = lambda c: F.when(c == 0, 0.5).when(c == 1, 0.7).when(c == 2, 0.9).otherwise(1.0)
    n = li.count()
    one = spread_by(li.select("l_partkey", "l_suppkey"), n, "l_partkey", "l_suppkey").distinct()
    a = one.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("CALLS").alias("edge_type"), weight((F.col("l_partkey") + F.col("l_suppkey")) % 4).alias("weight"))
    s = base(spark, sf_dir, "supplier")
    b = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("USES_TYPE"), F.lit(1.0))
    # lines move once by what they are met by, over tasks that grow with the lines, and so do pairs
    x = spread_by(li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l"), F.col("l_partkey").alias("a")), n, "l_orderkey", "l")
    y = spread_by(li.select("l_orderkey", F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("b")), n, "l_orderkey", "l")
    pair = spread_by(x.join(y, ["l_orderkey", "l"]).where("a <> b").select("a", "b"), n, "a", "b").distinct()
    c = pair.select(F.concat(F.lit("p"), F.col("a").cast("string")), F.concat(F.lit("p"), F.col("b").cast("string")), F.lit("REFERENCES"), weight((F.col("a") + F.col("b")) % 4))
    return a.union(b).union(c)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (parts) that occur in one order: symbol_a < symbol_b, cooccurrence_count."""
    from siltstone.operators.graphs import cooccurrence

    return cooccurrence(base(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


SQL = {
    "files": """SELECT doc_id AS file_id, source AS tenant_id, [lang, 'main'] AS branches,
      source || '/' || lang || '/doc_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.test.ts' ELSE '.txt' END AS file_path,
      CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS size_bytes, doc_id % 7 AS reindex_count, lang AS language, sha256(text) AS file_hash, text AS content FROM documents""",
    "lines": """SELECT doc_id AS file_id, CAST(i AS INTEGER) AS line_number, content
      FROM (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "points": "SELECT vec_id AS id, 't' || label AS tenant_id, CAST(embedding AS DOUBLE[]) AS dense, label FROM embeddings",
    "search_events": """SELECT event_id AS id, ts, user_id AS session_id,
      CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'open' WHEN 'error' THEN 'grep' WHEN 'signup' THEN 'expand' ELSE 'retrieve' END AS tool,
      CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'followup' ELSE 'open' END AS op,
      CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'user' END AS actor, 'p' || (user_id % 7) AS project_id,
      'query ' || (event_id % 40) || ' ' || event_type AS query_text,
      CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS result_count, CAST(round(value) AS BIGINT) AS latency_ms,
      CASE WHEN event_id % 6 = 0 THEN event_id - 6 END AS parent_event_id,
      CASE WHEN event_id % 4 <> 0 THEN CAST(round(value * 40) AS BIGINT) END AS bytes_in, CAST(round(value * 10) AS BIGINT) AS bytes_out,
      CASE WHEN event_id % 8 IN (0, 1) THEN 'lost' ELSE 'found' END AS resolution, value FROM events""",
    "timings": """SELECT l_orderkey AS queue_id, l_returnflag AS op, l_linestatus AS phase, CAST(l_quantity AS BIGINT) AS duration_ms,
      't' || (l_suppkey % 5) AS tenant_id, l_shipdate AS created_at FROM lineitem""",
    "queue": """SELECT o_orderkey AS queue_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status,
      CASE o_orderkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'folder' WHEN 2 THEN 'tenant' ELSE 'url' END AS item_type,
      CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op, 'c' || (o_custkey % 20) AS tenant_id,
      CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_at, o_orderkey % 5 AS retry_count,
      CASE o_orderkey % 6 WHEN 0 THEN 'connection refused' WHEN 1 THEN 'file not found' END AS error_message FROM orders""",
    "keywords": """SELECT doc_id, tenant_id, tag, CASE WHEN length(tag) >= 6 THEN 'concept' ELSE 'structural' END AS tag_type, 1.0::DOUBLE / (pos + 1) AS score
      FROM (SELECT doc_id, tenant_id, unnest(w) AS tag, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, source AS tenant_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents))
      WHERE length(tag) >= 4""",
    "graph_nodes": """SELECT 'p' || p_partkey AS node_id, 'sym_' || (p_partkey % 50) AS symbol_name, 'function' AS symbol_type, 'src/' || p_brand || '.py' AS file_path, p_partkey % 9 = 0 AS is_test FROM part
      UNION ALL SELECT 's' || s_suppkey, 'sup_' || s_suppkey, 'class', 'lib/' || s_nationkey || '.py', FALSE FROM supplier
      UNION ALL SELECT 'n' || n_nationkey, n_name, 'module', 'lib/all.py', FALSE FROM nation""",
    "graph_edges": """SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'CALLS' AS edge_type,
        CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS weight FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'USES_TYPE', 1.0 FROM supplier
      UNION ALL SELECT 'p' || a, 'p' || b, 'REFERENCES', CASE (a + b) % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 ELSE 1.0 END::DOUBLE
        FROM (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
          WHERE x.l_partkey <> y.l_partkey)""",
    "pairs": """SELECT x.p AS symbol_a, y.p AS symbol_b, count(*) AS cooccurrence_count
      FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) x
      JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) y ON x.o = y.o AND x.p < y.p GROUP BY ALL""",
}


def sql(text: str) -> str:
    """`text` with those views before it whose names stand in it as {name}."""
    used = [name for name in SQL if f"{{{name}}}" in text]
    for name in used:
        text = text.replace(f"{{{name}}}", name)
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in used)
    if not views:
        return text
    head, rest = ("WITH RECURSIVE ", text[len("WITH RECURSIVE ") :]) if text.startswith("WITH RECURSIVE ") else ("WITH ", text[len("WITH ") :] if text.startswith("WITH ") else None)
    return f"{head}{views}, {rest}" if rest is not None else f"WITH {views} {text}"
