"""Queries of source code. The tables hold none, so each document's words name the symbols of a source text, in one of two languages; SQL states what must be found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import code
from siltstone.plans._registry import Registry
from siltstone.sources import views as v

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_INDENTED = """import os
# class Hidden: pass
class C{1}(C{2}):
    '''def hidden(): x()'''
    def m_{3}(self, q: T{4}):
        return self.n_{4}(q)
    def n_{4}(self): return C{1}(1)
"""
_BRACED = """// class Hidden {
class C{1} extends C{2} implements I{3} {
  String s = "} class Hidden {";
  int m_{3}(T{4} q) { return n_{4}(q); }
  int n_{4}(int z) { return new C{1}(z).go_{2}(); }
}
"""
_WORDS = "w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM documents), s AS (SELECT doc_id, doc_id % 2 = 0 AS py, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d FROM w WHERE len(w) >= 4)"
_EDGES = _WORDS + """, e AS (
  SELECT doc_id, 'C' || a AS symbol, 'EXTENDS' AS kind, 'C' || b AS name FROM s UNION ALL SELECT doc_id, 'C' || a, 'IMPLEMENTS', 'I' || c FROM s WHERE NOT py
  UNION ALL SELECT doc_id, 'C' || a, 'CONTAINS', 'm_' || c FROM s UNION ALL SELECT doc_id, 'C' || a, 'CONTAINS', 'n_' || d FROM s
  UNION ALL SELECT doc_id, 'm_' || c, 'USES_TYPE', 'T' || d FROM s UNION ALL SELECT doc_id, 'm_' || c, 'CALLS', 'n_' || d FROM s
  UNION ALL SELECT doc_id, 'n_' || d, 'CALLS', 'C' || a FROM s UNION ALL SELECT doc_id, 'n_' || d, 'CALLS', 'go_' || b FROM s WHERE NOT py)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, content, language of a source text for each document of four words or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1))
    rows = v.base(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), words.alias("w")).where("size(w) >= 4")

    def filled(template: str):
        out = F.lit(template)
        for k in range(1, 5):
            out = F.replace(out, F.lit(f"{{{k}}}"), F.col("w")[k - 1])
        return out

    indented = F.col("file_id") % 2 == 0
    return rows.select("file_id", F.when(indented, filled(_INDENTED)).otherwise(filled(_BRACED)).alias("content"), F.when(indented, "python").otherwise("java").alias("language"))


@query("g11b_code_mentions", "WITH " + _EDGES + " SELECT doc_id AS file_id, symbol, kind, name FROM e")
def g11b(spark, d):
    found = code.symbols_and_mentions(sources(spark, d), "file_id", "content", "language")
    return found.where("kind <> 'DEFINES'").select("file_id", "symbol", "kind", "name")


@query("g11c_code_graph", "WITH " + _EDGES + """, f AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, 'C' || a AS name FROM s UNION ALL SELECT doc_id, 'm_' || c FROM s UNION ALL SELECT doc_id, 'n_' || d FROM s)),
  n AS (SELECT name, count(*) AS n FROM (SELECT 'C' || a AS name FROM s UNION ALL SELECT 'm_' || c FROM s UNION ALL SELECT 'n_' || d FROM s) GROUP BY name),
  r AS (SELECT e.kind, CASE WHEN f.name IS NOT NULL THEN 'same_file' WHEN n.n = 1 THEN 'unique' WHEN n.n <= 10 THEN 'split' END AS tier, CASE WHEN f.name IS NULL THEN n.n ELSE 1 END AS times FROM e LEFT JOIN f ON f.doc_id = e.doc_id AND f.name = e.name LEFT JOIN n ON n.name = e.name)
  SELECT kind, tier, sum(times)::BIGINT AS edges FROM r WHERE tier IS NOT NULL GROUP BY kind, tier""")
def g11c(spark, d):
    _, edges = code.code_graph(sources(spark, d), "file_id", "content", "language")
    return edges.groupBy("kind", "tier").agg(F.count("*").alias("edges"))


@query("g03b_impact_in_code", "WITH " + _WORDS + " SELECT doc_id AS file_id, 'n_' || d AS changed, 'm_' || c AS symbol FROM s")
def g03b(spark, d):
    """What calls each symbol that a file's second method is, one step away, by edges out of the texts."""
    nodes, edges = code.code_graph(sources(spark, d), "file_id", "content", "language")
    calls = edges.where("kind = 'CALLS' and tier = 'same_file'")
    changed = nodes.where("number = 2").select(F.col("node_id").alias("target"), F.col("symbol").alias("changed"))
    callers = nodes.select(F.col("node_id").alias("source"), "file_id", "symbol")
    return calls.join(changed, "target").join(callers, "source").where("symbol <> changed").select("file_id", "changed", "symbol")


_LINES = 6
_CHUNKED = "WITH x AS (SELECT doc_id, rpad(coalesce(regexp_extract(lower(coalesce(text, '')), '[a-z]+'), ''), 20, 'x') AS w FROM documents), m AS (SELECT doc_id, k, '    def m' || k || '(self):' || chr(10) || repeat('        v = ''' || w || '''' || chr(10), 6) AS t FROM x, (SELECT unnest([1, 2, 3, 4]) AS k))"


@query("e04b_structural_chunks", _CHUNKED + " SELECT doc_id AS file_id, (k - 1)::INTEGER AS chunk, CASE WHEN k = 1 THEN 'C' ELSE 'm' || k END AS symbol, CASE WHEN k = 1 THEN 'class C:' || chr(10) ELSE '' END || t AS text FROM m")
def e04b(spark, d):
    """A class that is too large for a chunk, of methods of which one fits."""
    word = F.rpad(F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+", 0), 20, "x")
    body = F.repeat(F.concat(F.lit("        v = '"), word, F.lit("'\n")), F.lit(_LINES))
    text = F.concat(F.lit("class C:\n"), *[x for k in range(1, 5) for x in (F.lit(f"    def m{k}(self):\n"), body)])
    files = v.base(spark, d, "documents").select(F.col("doc_id").alias("file_id"), text.alias("content"))
    return code.structural_chunks(files, "file_id", "content", F.lit("python"), 300).select("file_id", "chunk", "symbol", "text")
