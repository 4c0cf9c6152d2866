"""Queries of line search, paths and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import paths as p
from siltstone.operators import textsearch as t
from siltstone.plans import indexes
from siltstone.plans._registry import Registry
from siltstone.sources import views as v

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_PATH = "file_path"


@query("t01_exact_substring", "SELECT file_id, line_number FROM {lines} WHERE contains(content, 'that')")
def t01(spark, d):
    return t.exact_matches(v.lines(spark, d), "that").select("file_id", "line_number")


@query("t01b_exact_ignoring_case", "SELECT file_id, line_number FROM {lines} WHERE contains(lower(content), 'the and')")
def t01b(spark, d):
    return t.exact_matches(v.lines(spark, d), "The AND", ignore_case=True).select("file_id", "line_number")


@query("t01c_empty_pattern", "SELECT file_id, line_number FROM {lines} WHERE false")
def t01c(spark, d):
    return t.exact_matches(v.lines(spark, d), "").select("file_id", "line_number")


@query("t02_regex", "SELECT file_id, line_number FROM {lines} WHERE regexp_matches(content, 'tion[a-z]* of|[0-9]{3}-[0-9]{4}')")
def t02(spark, d):
    return t.regex_matches(v.lines(spark, d), "tion[a-z]* of|[0-9]{3}-[0-9]{4}").select("file_id", "line_number")


@query("t03_regex_with_literals", "SELECT file_id, line_number FROM {lines} WHERE regexp_matches(content, 'License|token = .[0-9a-f]+')")
def t03(spark, d):
    return t.regex_matches(v.lines(spark, d), "License|token = .[0-9a-f]+").select("file_id", "line_number")


_GROUPS = "(under|with) (the|a) [A-Za-z]+ licen[cs]e|token = .[0-9a-f]+"


@query("t02b_indexed_regex", f"SELECT file_id, line_number, content FROM {{lines}} WHERE regexp_matches(content, '{_GROUPS}')")
def t02b(spark, d):
    """Groups and alternations by way of the trigram index."""
    return indexes.lines(spark, d).search(_GROUPS)


@query("t02c_indexed_without_literals", "SELECT file_id, line_number FROM {lines} WHERE regexp_matches(content, '[0-9]{3}.?[0-9]{4}$|^.{1,3}$')")
def t02c(spark, d):
    """A pattern that asks for no trigram: all units are read."""
    return indexes.lines(spark, d).search("[0-9]{3}.?[0-9]{4}$|^.{1,3}$").select("file_id", "line_number")


@query("t03b_indexed_any_case", "SELECT file_id, line_number FROM {lines} WHERE regexp_matches(content, '(?i)(mit|apache|gpl|bsd)[ -]licen[cs]e|(api|access)[_ ]?(key|token)')")
def t03b(spark, d):
    return indexes.lines(spark, d).search("(mit|apache|gpl|bsd)[ -]licen[cs]e|(api|access)[_ ]?(key|token)", ignore_case=True).select("file_id", "line_number")


@query("t01d_indexed_substring", "SELECT file_id, line_number FROM {lines} WHERE contains(content, 'License')")
def t01d(spark, d):
    """Over an index that was appended in two segments."""
    return indexes.lines(spark, d, 2).exact("License").select("file_id", "line_number")


@query("t01e_indexed_ignoring_case", "SELECT file_id, line_number FROM {lines} WHERE contains(lower(content), 'under the mit')")
def t01e(spark, d):
    return indexes.lines(spark, d, 2).exact("UNDER the mit", ignore_case=True).select("file_id", "line_number")


@query("s09b_line_index_search", "SELECT l.file_id, l.line_number, f.file_path FROM {lines} l JOIN {files} f USING (file_id) WHERE f.tenant_id = 'src3' AND regexp_matches(l.content, 'Licen[cs]e|warrant(y|ies)')")
def s09b(spark, d):
    """Matches out of the index, then the files in scope."""
    found = t.scoped(indexes.lines(spark, d).search("Licen[cs]e|warrant(y|ies)"), v.files(spark, d), tenant="src3")
    return found.select("file_id", "line_number", "file_path")


@query("t04_unique_matches", "SELECT DISTINCT f.tenant_id, l.content FROM {lines} l JOIN {files} f USING (file_id) WHERE contains(l.content, 'License')")
def t04(spark, d):
    m = t.scoped(t.exact_matches(v.lines(spark, d), "License"), v.files(spark, d))
    return t.unique_matches(m).select("tenant_id", "content").dropDuplicates()


_CONTEXT = """WITH m AS (SELECT file_id, line_number FROM {lines} WHERE contains(content, 'License'))
SELECT m.file_id, m.line_number, coalesce(array_to_string(list(l.content ORDER BY l.line_number) FILTER (l.line_number < m.line_number), chr(10)), '') AS before_,
  coalesce(array_to_string(list(l.content ORDER BY l.line_number) FILTER (l.line_number > m.line_number), chr(10)), '') AS after_
FROM m LEFT JOIN lines l ON l.file_id = m.file_id AND l.line_number BETWEEN m.line_number - 2 AND m.line_number + 2 AND l.line_number <> m.line_number GROUP BY m.file_id, m.line_number"""


@query("t05_context_lines", _CONTEXT)
def t05(spark, d):
    l = v.lines(spark, d)
    m = t.with_context(t.exact_matches(l, "License").select("file_id", "line_number"), l, 2)
    return m.select("file_id", "line_number", F.array_join("before", "\n").alias("before_"), F.array_join("after", "\n").alias("after_"))


@query("t06_count_matches", "SELECT least(10000, count(*)) AS n FROM {lines} WHERE contains(content, 'tion')")
def t06(spark, d):
    return t.count_matches(v.lines(spark, d), "tion")


@query("t07_capped_window", "WITH m AS (SELECT file_id, line_number FROM {lines} WHERE contains(content, 'that')) SELECT file_id, line_number, (SELECT count(*) FROM m) > 20 AS truncated FROM m ORDER BY file_id, line_number LIMIT 20")
def t07(spark, d):
    return t.capped(t.exact_matches(v.lines(spark, d), "that").select("file_id", "line_number"), ["file_id", "line_number"], 20)


@query("t08_grep_with_excludes", "SELECT l.file_id, l.line_number, left(l.content, 40) AS content FROM {lines} l JOIN {files} f USING (file_id) WHERE contains(l.content, 'License') AND NOT regexp_matches(f.file_path, '^(.*/)?de(/.*)?$') AND regexp_matches(f.file_path, '\\.(md|txt)$')")
def t08(spark, d):
    m = t.scoped(t.exact_matches(v.lines(spark, d), "License"), v.files(spark, d), include="*.{md,txt}", exclude="de")
    return m.select("file_id", "line_number", F.left("content", F.lit(40)).alias("content"))


@query("t09_line_changes", """WITH o AS (SELECT file_id, content, line_number, row_number() OVER (PARTITION BY file_id, content ORDER BY line_number) AS k FROM {lines}),
  n AS (SELECT file_id, content, line_number, row_number() OVER (PARTITION BY file_id, content ORDER BY line_number) AS k FROM (SELECT file_id, CASE WHEN line_number % 5 = 0 THEN upper(content) ELSE content END AS content, line_number FROM lines WHERE line_number % 7 <> 0))
  SELECT coalesce(o.file_id, n.file_id) AS file_id, CASE WHEN o.file_id IS NULL THEN 'inserted' WHEN n.file_id IS NULL THEN 'deleted' ELSE 'unchanged' END AS state, count(*) AS n FROM o FULL JOIN n ON o.file_id = n.file_id AND o.content = n.content AND o.k = n.k GROUP BY ALL""")
def t09(spark, d):
    old = v.lines(spark, d)
    new = old.where("line_number % 7 <> 0").withColumn("content", F.when(F.col("line_number") % 5 == 0, F.upper("content")).otherwise(F.col("content")))
    return t.line_changes(old, new).groupBy("file_id", "state").agg(F.count("*").alias("n"))


@query("t09b_shortest_edits", """WITH n AS (SELECT file_id, count(*) AS old, count(*) FILTER (line_number % 7 <> 0) AS new, count(*) FILTER (line_number % 7 <> 0 AND line_number % 5 <> 0) AS kept FROM {lines} GROUP BY file_id)
  SELECT file_id, kept AS unchanged, old - kept AS removed, new - kept AS added FROM n""")
def t09b(spark, d):
    """Every seventh line is taken out, of the rest every fifth is written anew in a way that no other line has: a longest common part is all others."""
    files = v.base(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")).where("content is not null")
    at = F.transform(F.split("content", "\n"), lambda x, k: F.struct(x.alias("x"), (k + 1).alias("k")))
    kept = F.filter(at, lambda y: y["k"] % 7 != 0)
    new = F.transform(kept, lambda y: F.when(y["k"] % 5 == 0, F.concat(F.lit("line "), y["k"].cast("string"), F.lit(" of another text \u2603"))).otherwise(y["x"]))
    edits = t.line_diff(files, files.select("file_id", F.array_join(new, "\n").alias("content")))
    count = lambda *ops: F.count_if(F.col("op").isin(*ops))
    return edits.groupBy("file_id").agg(count("unchanged").alias("unchanged"), count("changed", "deleted").alias("removed"), count("changed", "inserted").alias("added"))


@query("t10_line_sequence", "SELECT file_id, line_number, line_number * 1000.0::DOUBLE AS seq FROM {lines}")
def t10(spark, d):
    return t.line_sequence(v.lines(spark, d)).select("file_id", "line_number", "seq")


@query("t11_orphan_lines", "SELECT file_id, count(*) AS n FROM {lines} WHERE file_id NOT IN (SELECT file_id FROM {files} WHERE reindex_count <> 3) GROUP BY file_id")
def t11(spark, d):
    kept = v.files(spark, d).where("reindex_count <> 3").select("file_id")
    return v.lines(spark, d).join(kept, "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("n"))


@query("t12_branch_mirror", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'dev' ELSE '' END AS add_, CASE WHEN file_id % 2 = 0 THEN 'main' ELSE '' END AS remove_ FROM {files} WHERE file_id % 3 = 0 OR file_id % 2 = 0")
def t12(spark, d):
    f = v.files(spark, d).select("file_id", "branches")
    tracked = f.withColumn("branches", F.when(F.col("file_id") % 2 == 0, F.array_remove("branches", "main")).otherwise(F.col("branches"))).withColumn("branches", F.when(F.col("file_id") % 3 == 0, F.array_append("branches", "dev")).otherwise(F.col("branches")))
    r = t.branch_repairs(f, tracked)
    return r.select("file_id", F.array_join("add", ",").alias("add_"), F.array_join("remove", ",").alias("remove_"))


@query("s10_scan_without_index", "SELECT f.file_path, count(*) AS n FROM {lines} l JOIN {files} f USING (file_id) WHERE regexp_matches(l.content, '[0-9]{4}') GROUP BY f.file_path")
def s10(spark, d):
    return t.scoped(t.regex_matches(v.lines(spark, d), "[0-9]{4}"), v.files(spark, d)).groupBy(_PATH).agg(F.count("*").alias("n"))


@query("s09_line_index_scan", "SELECT l.file_id, l.line_number, f.file_path FROM {lines} l JOIN {files} f USING (file_id) WHERE f.tenant_id = 'src3' AND list_contains(f.branches, 'en') AND contains(l.content, 'the')")
def s09(spark, d):
    m = t.scoped(t.exact_matches(v.lines(spark, d), "the"), v.files(spark, d), tenant="src3", branch="en")
    return m.select("file_id", "line_number", _PATH)


@query("p03_branch_fallback", "SELECT file_id FROM {files} WHERE list_contains(branches, 'de') OR (list_contains(branches, 'main') AND tenant_id || file_id % 3 NOT IN (SELECT tenant_id || file_id % 3 FROM files WHERE list_contains(branches, 'de')))")
def p03(spark, d):
    f = v.files(spark, d).withColumn("path", F.concat("tenant_id", (F.col("file_id") % 3).cast("string")))
    asked = f.where(F.array_contains("branches", "de"))
    other = f.where(F.array_contains("branches", "main") & ~F.array_contains("branches", "de")).join(asked.select("path").distinct(), "path", "left_anti")
    return asked.select("file_id").unionByName(other.select("file_id"))


@query("p04_include_glob", "SELECT file_id FROM {files} WHERE regexp_matches(file_path, '^(.*/)?doc_1.*\\.(py|md)$')")
def p04(spark, d):
    return v.files(spark, d).where(p.included(F.col(_PATH), "doc_1*.{py,md}")).select("file_id")


@query("p05_normalised_globs", """SELECT g.pattern, g.made, count(f.file_id) AS files FROM (VALUES ('/src1/en/*.md', '/src1/en/*.md', '^/src1/en/[^/]*[.]md$'), ('**/de/*.py', '**/de/*.py', '^(.*/)?de/[^/]*[.]py$'), ('*.md', '**/*.md', '^(.*/)?[^/]*[.]md$'), ('src2/', '**/src2/**', '^(.*/)?src2/.*$'), ('fr', '**/fr{,/**}', '^(.*/)?fr(/.*)?$')) g(pattern, made, shape)
  LEFT JOIN {files} f ON regexp_matches('/' || f.file_path, g.shape) GROUP BY g.pattern, g.made""")
def p05(spark, d):
    """How patterns are completed, and how many files each finds."""
    globs = ("/src1/en/*.md", "**/de/*.py", "*.md", "src2/", "fr")
    path = F.concat(F.lit("/"), "file_path")
    counts = v.files(spark, d).agg(*[F.count_if(p.included(path, p.normal_glob(g))).alias(f"n{k}") for k, g in enumerate(globs)])
    rows = F.array(*[F.struct(F.lit(g).alias("pattern"), F.lit(p.normal_glob(g)).alias("made"), F.col(f"n{k}").alias("files")) for k, g in enumerate(globs)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("p06_exclude_glob", "SELECT file_id FROM {files} WHERE NOT regexp_matches(file_path, '^(.*/)?src1[^/]*(/.*)?$')")
def p06(spark, d):
    return v.files(spark, d).where(~p.excluded(F.col(_PATH), "src1*")).select("file_id")


@query("p07_path_prefix_include", "SELECT file_id FROM {files} WHERE starts_with(file_path, 'src2/en/')")
def p07(spark, d):
    g = "/src2/en/**"
    f = v.files(spark, d).withColumn("abs", F.concat(F.lit("/"), _PATH))
    return f.where(F.col("abs").startswith(p.literal_prefix(g)) & p.included(F.col("abs"), g)).select("file_id")


@query("p08_foreign_worktrees", "SELECT file_id, file_id % 3 = 1 AS hidden FROM {files}")
def p08(spark, d):
    f = v.files(spark, d)
    path = F.when(F.col("file_id") % 3 == 1, F.concat(F.lit(".claude/worktrees/x/"), "file_path")).when(F.col("file_id") % 3 == 2, F.concat(F.lit("y/.claude/worktrees/me/"), "file_path")).otherwise(F.col("file_path"))
    return f.select("file_id", p.foreign_worktree(path, "me").alias("hidden"))


@query("p10_component_match", "SELECT file_id FROM {files} WHERE tenant_id || '.' || language = 'src1' OR starts_with(tenant_id || '.' || language, 'src1.')")
def p10(spark, d):
    f = v.files(spark, d).withColumn("component", F.concat_ws(".", "tenant_id", "language"))
    return f.where(p.component_matches(F.col("component"), "src1")).select("file_id")


@query("p13_library_prefix", "SELECT file_id FROM {files} WHERE starts_with(file_path, 'src1/fr/')")
def p13(spark, d):
    return v.files(spark, d).where(p.below_prefix(F.col(_PATH), "/src1/fr/")).select("file_id")


@query("p14_test_files", "SELECT file_id, file_path LIKE '%.test.ts' AS is_test FROM {files}")
def p14(spark, d):
    return v.files(spark, d).select("file_id", p.is_test_file(F.col(_PATH)).alias("is_test"))


@query("p15_file_classes", "SELECT file_id, CASE WHEN file_path LIKE '%.md' OR file_path LIKE '%.txt' THEN 'docs' ELSE 'code' END AS kind FROM {files}")
def p15(spark, d):
    return v.files(spark, d).select("file_id", p.file_class(F.col(_PATH)).alias("kind"))


@query("d25_candidate_paths", "SELECT DISTINCT file_path FROM {files} WHERE tenant_id = 'src4' AND list_contains(branches, 'main') AND NOT regexp_matches(file_path, '\\.txt$')")
def d25(spark, d):
    f = v.files(spark, d).where("tenant_id = 'src4'").where(F.array_contains("branches", "main") & ~p.excluded(F.col(_PATH), "*.txt"))
    return f.select(_PATH).distinct()
