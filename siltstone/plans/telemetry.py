"""Queries over event logs, timings, queues and catalogues, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import telemetry as t
from siltstone.plans._registry import Registry
from siltstone.sources import views as v

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def with_value(df: DataFrame, value: DataFrame) -> DataFrame:
    """`df` with the columns of `value`, a global aggregate and so one row, as constants."""
    row = value.first()
    return df.select("*", *[F.lit(row[c]).cast(value.schema[c].dataType).alias(c) for c in value.columns])


@query("a01_group_counts", "SELECT tool, op, count(*) AS n FROM {search_events} GROUP BY ALL")
def a01(spark, d):
    return t.group_counts(v.search_events(spark, d), "tool", "op")


@query("a02_percent_of_total", "SELECT tool, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM {search_events} GROUP BY tool")
def a02(spark, d):
    return t.share_of_total(v.search_events(spark, d), "tool")


@query("a03_conditional_sums", "SELECT tool, count(*) AS n, count(*) FILTER (result_count = 0) AS empty, count(*) FILTER (result_count = 0) / count(*) AS empty_rate FROM {search_events} GROUP BY tool")
def a03(spark, d):
    e = v.search_events(spark, d)
    return e.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("result_count") == 0).alias("empty"), t.rate(F.col("result_count") == 0, "empty_rate"))


@query("a04_count_distinct", "SELECT tenant_id, count(DISTINCT queue_id) AS items, count(DISTINCT op) AS ops FROM {timings} GROUP BY tenant_id")
def a04(spark, d):
    return v.timings(spark, d).groupBy("tenant_id").agg(F.countDistinct("queue_id").alias("items"), F.countDistinct("op").alias("ops"))


_NEAREST = """r AS (SELECT {k}, {x}, row_number() OVER (PARTITION BY {k} ORDER BY {x}) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM {v} WHERE {x} IS NOT NULL)
SELECT {k}, max(n) AS n, {cols} FROM r GROUP BY {k}"""


def _nearest(view: str, keys: str, value: str) -> str:
    cols = ", ".join(f"max(CASE WHEN rn = greatest(1, CAST(round({p} * (n - 1)) AS BIGINT) + 1) THEN {value} END) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99))
    return "WITH " + _NEAREST.replace("{k}", keys).replace("{x}", value).replace("{cols}", cols).replace("{v}", "{" + view + "}")


@query("a05_nearest_rank_percentiles", _nearest("search_events", "tool", "latency_ms"))
def a05(spark, d):
    return t.nearest_rank(v.search_events(spark, d), ["tool"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("a06_mean_and_standard_error", "SELECT op, phase, count(duration_ms) AS n, avg(duration_ms) AS mean, round(coalesce(stddev_samp(duration_ms) / sqrt(count(duration_ms)), 0), 9) AS std_error FROM {timings} GROUP BY op, phase")
def a06(spark, d):
    return t.mean_and_error(v.timings(spark, d), ["op", "phase"], "duration_ms").withColumn("std_error", F.round("std_error", 9))


@query("a07_interpolated_percentiles", """SELECT tool, count(latency_ms) AS n, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5)::DOUBLE AS p50, round(quantile_cont(latency_ms, 0.95), 6)::DOUBLE AS p95,
  round(quantile_cont(latency_ms, 0.99), 6)::DOUBLE AS p99, round(stddev_pop(latency_ms), 6) AS std_dev, min(latency_ms) AS lowest, max(latency_ms) AS highest FROM {search_events} GROUP BY tool""")
def a07(spark, d):
    s = t.latency_summary(v.search_events(spark, d), ["tool"], "latency_ms")
    return s.withColumns({c: F.round(c, 6) for c in ("p95", "p99", "std_dev")})


@query("a08_phase_stats", "SELECT op, phase, count(*) AS n, min(duration_ms) AS lowest, CAST(round(avg(duration_ms)) AS BIGINT) AS mean, max(duration_ms) AS highest, sum(duration_ms)::BIGINT AS total FROM {timings} GROUP BY op, phase")
def a08(spark, d):
    return t.phase_stats(v.timings(spark, d), ["op", "phase"], "duration_ms")


@query("a08b_phase_percentiles", _nearest("timings", "op, phase", "duration_ms"))
def a08b(spark, d):
    return t.nearest_rank(v.timings(spark, d), ["op", "phase"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


_FOLLOWED = """WITH soon AS (SELECT DISTINCT a.id FROM {search_events} a JOIN search_events b ON a.session_id = b.session_id AND a.tool = b.tool AND b.op = 'followup' AND b.parent_event_id IS NULL
    AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 1 AND 60000000),
  f AS (SELECT *, EXISTS (SELECT 1 FROM soon WHERE soon.id = e.id) OR EXISTS (SELECT 1 FROM search_events c WHERE c.parent_event_id = e.id AND c.op IN ('search', 'followup')) AS had_followup,
    EXISTS (SELECT 1 FROM search_events c WHERE c.parent_event_id = e.id AND c.op = 'open' AND c.result_count > 0) AS had_escalation FROM search_events e)
"""


@query("a09_token_savings_by_tool", _FOLLOWED + "SELECT tool, count(*) AS n, sum(bytes_in - bytes_out)::BIGINT AS saved, count(*) FILTER (had_followup) AS followups, count(*) FILTER (had_escalation) AS escalations FROM f WHERE bytes_in IS NOT NULL GROUP BY tool")
def a09(spark, d):
    return t.token_savings(v.search_events(spark, d)).groupBy("tool").agg(F.count("*").alias("n"), F.sum("saved_bytes").alias("saved"), F.count_if("had_followup").alias("followups"), F.count_if("had_escalation").alias("escalations"))


@query("m01_token_savings_view", _FOLLOWED + "SELECT id, bytes_in - bytes_out AS saved_bytes, round(CASE WHEN bytes_in > 0 THEN 1 - bytes_out / bytes_in END, 9) AS saved_ratio, had_followup, had_escalation FROM f WHERE bytes_in IS NOT NULL")
def m01(spark, d):
    return t.token_savings(v.search_events(spark, d)).select("id", "saved_bytes", F.round("saved_ratio", 9).alias("saved_ratio"), "had_followup", "had_escalation")


@query("m02_token_economy", _FOLLOWED + "SELECT op, actor, count(*) AS n, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, avg(CASE WHEN had_followup THEN 1.0 ELSE 0.0 END)::DOUBLE AS followup_rate FROM f WHERE bytes_in IS NOT NULL AND ts > (SELECT max(ts) FROM search_events) - INTERVAL 24 HOUR GROUP BY op, actor")
def m02(spark, d):
    e = v.search_events(spark, d)
    as_of = e.agg(F.max("ts").alias("as_of"))
    recent = t.token_savings(e).join(F.broadcast(as_of), F.col("ts") > F.col("as_of") - F.expr("INTERVAL 24 HOURS"))
    return recent.groupBy("op", "actor").agg(F.count("*").alias("n"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.avg(F.col("had_followup").cast("double")).alias("followup_rate"))


@query("m03_follow_up_linkage", r"""WITH e AS (SELECT id, session_id, epoch_us(ts) AS us, list_distinct(regexp_split_to_array(lower(query_text), '\s+')) AS w FROM {search_events}),
  m AS (SELECT a.id, b.id AS pid, b.us, list_intersect(a.w, b.w) AS s FROM e a JOIN e b ON a.session_id = b.session_id AND b.us < a.us AND a.us - b.us <= 3600000000)
  SELECT id, max(struct_pack(us := us, pid := pid)).pid AS parent FROM m WHERE len(s) >= 2 OR len(list_filter(s, lambda x: length(x) >= 5)) > 0 GROUP BY id""")
def m03(spark, d):
    return t.follow_up_parent(v.search_events(spark, d), 3600)


@query("m04_escalation_linkage", """SELECT r.id, max(s.id) AS from_id FROM {search_events} r JOIN search_events s ON r.session_id = s.session_id AND epoch_us(r.ts) - epoch_us(s.ts) BETWEEN 0 AND 7200000000
  AND list_contains([s.id % 40, (s.id + 1) % 40, (s.id + 2) % 40], r.id % 40) WHERE r.tool = 'retrieve' AND s.tool = 'search' GROUP BY r.id""")
def m04(spark, d):
    e = v.search_events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    hits = e.where("tool = 'search'").select("session_id", F.col("id").alias("sid"), F.col("us").alias("sus"), F.array(*[(F.col("id") + k) % 40 for k in range(3)]).alias("refs"))
    hour = 7_200_000_000
    hits = hits.withColumn("b", F.explode(F.array(F.floor(F.col("sus") / hour), F.floor(F.col("sus") / hour) + 1)))
    asked = e.where("tool = 'retrieve'").select("id", "session_id", "us", (F.col("id") % 40).alias("ref"), F.floor(F.col("us") / hour).alias("b"))
    met = asked.join(hits, ["session_id", "b"]).where(F.array_contains("refs", F.col("ref")) & F.col("us").between(F.col("sus"), F.col("sus") + hour))
    return met.groupBy("id").agg(F.max("sid").alias("from_id"))


@query("a10_tag_list", "SELECT tag, count(DISTINCT doc_id) AS docs, round(avg(score), 4) AS avg_score FROM {keywords} WHERE tag_type = 'concept' GROUP BY tag ORDER BY docs DESC, avg_score DESC, tag LIMIT 50")
def a10(spark, d):
    k = v.keywords(spark, d).where("tag_type = 'concept'")
    return k.groupBy("tag").agg(F.countDistinct("doc_id").alias("docs"), F.round(F.avg("score"), 4).alias("avg_score")).orderBy(F.desc("docs"), F.desc("avg_score"), "tag").limit(50)


@query("a11_having_distinct", "SELECT tag, count(DISTINCT doc_id) AS docs FROM {keywords} GROUP BY tag HAVING count(DISTINCT doc_id) >= 5")
def a11(spark, d):
    return v.keywords(spark, d).groupBy("tag").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 5")


@query("a12_set_aggregates", "SELECT tenant_id, array_to_string(list_sort(list_distinct(flatten(list(branches)))), ',') AS branches FROM {files} GROUP BY tenant_id")
def a12(spark, d):
    b = v.files(spark, d).select("tenant_id", F.explode("branches").alias("b"))
    return b.groupBy("tenant_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("b"))).alias("branches"))


_HOURLY = "WITH h AS (SELECT event_type AS metric_name, date_trunc('hour', ts) AS ts, avg(value) AS metric_value FROM events GROUP BY ALL)"


@query("a13_daily_from_hourly", _HOURLY + " SELECT metric_name, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(avg(metric_value), 10) AS metric_value FROM h GROUP BY metric_name, date_trunc('day', ts)")
def a13(spark, d):
    e = v.base(spark, d, "events").select(F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), "ts")
    daily = t.rolled_up(t.rolled_up(e, "hour"), "day")
    return daily.select("metric_name", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("metric_value", 10).alias("metric_value"))


@query("a13w_weekly_from_daily", _HOURLY + ", y AS (SELECT metric_name, date_trunc('day', ts) AS ts, avg(metric_value) AS metric_value FROM h GROUP BY ALL) SELECT metric_name, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, round(avg(metric_value), 10) AS metric_value FROM y GROUP BY metric_name, date_trunc('week', ts)")
def a13w(spark, d):
    e = v.base(spark, d, "events").select(F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), "ts")
    weekly = t.rolled_up(t.rolled_up(t.rolled_up(e, "hour"), "day"), "week")
    return weekly.select("metric_name", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("metric_value", 10).alias("metric_value"))


@query("a14_metric_range", "SELECT event_type AS metric_name, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def a14(spark, d):
    e = v.base(spark, d, "events").where("ts >= timestamp_ntz '2024-01-10 00:00:00' and ts < timestamp_ntz '2024-01-20 00:00:00'")
    return e.groupBy(F.col("event_type").alias("metric_name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("a15_retention", "WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'hourly' ELSE 'daily' END AS period, date_diff('second', ts, (SELECT max(ts) FROM events)) AS age FROM events) SELECT event_id, period FROM p WHERE CASE period WHEN 'raw' THEN age <= 86400 WHEN 'hourly' THEN age <= 604800 ELSE age <= 2592000 END")
def a15(spark, d):
    e = v.base(spark, d, "events").withColumn("period", F.when(F.col("event_id") % 3 == 0, "raw").when(F.col("event_id") % 3 == 1, "hourly").otherwise("daily"))
    e = with_value(e, e.agg(F.max("ts").alias("as_of")))
    return t.retained(e, F.col("as_of"), {"raw": 24, "hourly": 168, "daily": 720}).select("event_id", "period")


@query("a17_directory_rollup", r"""WITH r AS (SELECT array_to_string(string_split(file_path, '/')[1:2], '/') AS parent, regexp_extract(file_path, '\.([^./]+)$', 1) AS ext, CAST(file_id % 6 = 0 AS INTEGER) AS f FROM {files} WHERE len(string_split(file_path, '/')) > 2),
  e AS (SELECT parent, ext, count(*) AS c, sum(f) AS f FROM r GROUP BY ALL)
  SELECT parent, sum(c)::BIGINT AS n, round(sum(f) / sum(c), 9) AS failure_rate, round(max(c) / sum(c), 9) AS homogeneity, round(sum(c) * (1 + 2 * sum(f) / sum(c) + max(c) / sum(c)), 6) AS score FROM e GROUP BY parent""")
def a17(spark, d):
    f = v.files(spark, d).withColumn("failed", F.col("file_id") % 6 == 0)
    s = t.directory_scores(f, 2)
    return s.select("parent", "n", F.round("failure_rate", 9).alias("failure_rate"), F.round("homogeneity", 9).alias("homogeneity"), F.round("score", 6).alias("score"))


@query("a18_queue_breakdown", "SELECT item_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, min(created_at) FILTER (status = 'pending') AS oldest_pending FROM {queue} GROUP BY item_type")
def a18(spark, d):
    q = v.queue(spark, d)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "done", "failed")]
    return q.groupBy("item_type").agg(*counts, F.min(F.when(F.col("status") == "pending", F.col("created_at"))).alias("oldest_pending"))


@query("a19_rate_and_eta", """WITH x AS (SELECT tenant_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status <> 'done') AS left_, min(created_at) FILTER (status = 'done') AS first, max(created_at) AS last FROM {queue} GROUP BY tenant_id)
  SELECT tenant_id, done, left_ AS remaining, round(done / (date_diff('second', first, last) / 60.0), 9)::DOUBLE AS per_minute, round(left_ / (done / (date_diff('second', first, last) / 60.0)), 3)::DOUBLE AS eta_minutes FROM x WHERE done > 0 AND date_diff('second', first, last) > 0""")
def a19(spark, d):
    done = F.col("status") == "done"
    x = v.queue(spark, d).groupBy("tenant_id").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), F.min(F.when(done, F.col("created_at"))).alias("a"), F.max("created_at").alias("b"))
    minutes = F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / 60.0
    x = x.where((F.col("done") > 0) & (minutes > 0)).withColumn("r", F.col("done") / minutes)
    return x.select("tenant_id", "done", "remaining", F.round("r", 9).alias("per_minute"), F.round(F.col("remaining") / F.col("r"), 3).alias("eta_minutes"))


@query("a22_two_level_grouping", "SELECT tenant_id, op, count(*) AS n, round(avg(duration_ms), 6) AS mean FROM {timings} GROUP BY tenant_id, op")
def a22(spark, d):
    return v.timings(spark, d).groupBy("tenant_id", "op").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean"))


@query("a26_status_overview", "SELECT item_type, tenant_id, status, count(*) AS n FROM {queue} GROUP BY ALL")
def a26(spark, d):
    return t.group_counts(v.queue(spark, d), "item_type", "tenant_id", "status")


@query("a27_alerts", "WITH x AS (SELECT tenant_id, count(*) AS processed, count(*) FILTER (status = 'failed') AS errors FROM {queue} GROUP BY tenant_id) SELECT tenant_id, processed, errors, CASE WHEN processed = 0 THEN 'none' WHEN errors * 100.0 / processed > 2 * 2.5 THEN 'critical' WHEN errors * 100.0 / processed > 2.5 THEN 'warning' ELSE 'none' END AS level FROM x")
def a27(spark, d):
    x = v.queue(spark, d).groupBy("tenant_id").agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "failed").alias("errors"))
    return x.withColumn("level", t.alerts(F.col("processed"), F.col("errors"), 2.5))


@query("a28_flip_flops", "WITH x AS (SELECT session_id, lag(tool) OVER (PARTITION BY session_id ORDER BY ts, id) <> tool AS c FROM {search_events}) SELECT session_id, count(*) AS n, count(*) FILTER (c) AS flips FROM x GROUP BY session_id")
def a28(spark, d):
    return t.flips(v.search_events(spark, d), "session_id", "tool", "ts", "id")


@query("w01_row_number_by_group", "SELECT id, tool, row_number() OVER (PARTITION BY tool ORDER BY latency_ms, id) AS rn FROM {search_events}")
def w01(spark, d):
    return v.search_events(spark, d).select("id", "tool", F.row_number().over(W.partitionBy("tool").orderBy("latency_ms", "id")).cast("long").alias("rn"))


_PREV = """WITH e AS (SELECT *, lag(tool) OVER w AS prev_tool, lag(op) OVER w AS prev_op, lag(query_text) OVER w AS prev_query, lag(ts) OVER w AS prev_ts, lead(tool) OVER w AS next_tool, lead(op) OVER w AS next_op, lead(ts) OVER w AS next_ts
  FROM {search_events} WINDOW w AS (PARTITION BY session_id ORDER BY ts, id))
"""


@query("w03_lag_lead", _PREV + "SELECT id, prev_tool, prev_op, prev_ts, next_tool, next_op, next_ts FROM e")
def w03(spark, d):
    return t.with_previous(v.search_events(spark, d)).select("id", "prev_tool", "prev_op", "prev_ts", "next_tool", "next_op", "next_ts")


@query("w04_behaviour_classes", _PREV + """SELECT id, CASE WHEN tool = 'grep' AND coalesce(prev_tool, '') <> 'search' THEN 'bypass' WHEN tool = 'search' AND next_op = 'open' THEN 'success'
  WHEN tool = 'search' AND prev_tool = 'grep' AND epoch_us(ts) - epoch_us(prev_ts) < 3600000000 THEN 'fallback' ELSE 'unknown' END AS behavior FROM e""")
def w04(spark, d):
    return t.behaviour(v.search_events(spark, d), 3600).select("id", "behavior")


@query("w05_session_chains", _PREV + """SELECT id, CASE WHEN parent_event_id IS NOT NULL THEN 'lineage' WHEN epoch_us(ts) - epoch_us(prev_ts) <= 3600000000 AND prev_tool = 'search' AND tool IN ('open', 'retrieve') THEN 'escalation'
  WHEN epoch_us(ts) - epoch_us(prev_ts) <= 3600000000 AND prev_tool = tool AND prev_query IS DISTINCT FROM query_text THEN 'reformulation' ELSE 'root' END AS link FROM e""")
def w05(spark, d):
    return t.chain_links(v.search_events(spark, d), 3600).select("id", "link")


@query("w06_fast_follow_ups", _PREV + "SELECT tool, count(*) AS n, count(*) FILTER (epoch_us(ts) - epoch_us(prev_ts) < 3600000000) AS fast, round(100.0 * count(*) FILTER (epoch_us(ts) - epoch_us(prev_ts) < 3600000000) / count(*), 2)::DOUBLE AS pct FROM e GROUP BY tool")
def w06(spark, d):
    return t.fast_follow_ups(v.search_events(spark, d), 3600)


@query("m10_usage_overview", _PREV + "SELECT project_id, count(*) AS n, round(count(*) FILTER (resolution = 'found') / count(*), 9) AS resolution_rate, count(DISTINCT query_text) AS queries, count(*) FILTER (tool = 'grep' AND coalesce(prev_tool, '') <> 'search') AS bypasses FROM e GROUP BY project_id")
def m10(spark, d):
    e = t.behaviour(v.search_events(spark, d))
    return e.groupBy("project_id").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("resolution") == "found") / F.count("*"), 9).alias("resolution_rate"), F.countDistinct("query_text").alias("queries"), F.count_if(F.col("behavior") == "bypass").alias("bypasses"))


@query("m10b_top_queries", "SELECT query_text, count(*) AS n, round(avg(result_count), 6) AS mean_results FROM {search_events} GROUP BY query_text ORDER BY n DESC, query_text LIMIT 10")
def m10b(spark, d):
    return v.search_events(spark, d).groupBy("query_text").agg(F.count("*").alias("n"), F.round(F.avg("result_count"), 6).alias("mean_results")).orderBy(F.desc("n"), "query_text").limit(10)


@query("m09_agent_economy", "SELECT actor, tool, count(*) FILTER (resolution = 'found') AS completed, round(sum(bytes_out) / count(*) FILTER (resolution = 'found'), 6) AS cost_per_completed FROM {search_events} GROUP BY actor, tool HAVING count(*) FILTER (resolution = 'found') > 0")
def m09(spark, d):
    done = F.count_if(F.col("resolution") == "found")
    g = v.search_events(spark, d).groupBy("actor", "tool").agg(done.alias("completed"), F.sum("bytes_out").alias("cost")).where("completed > 0")
    return g.select("actor", "tool", "completed", F.round(F.col("cost") / F.col("completed"), 6).alias("cost_per_completed"))


@query("m08_signed_rank_sums", """WITH x AS (SELECT avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0) AS dd FROM events GROUP BY user_id), y AS (SELECT round(dd, 9) AS d FROM x WHERE dd IS NOT NULL AND round(dd, 9) <> 0),
  c AS (SELECT abs(d) AS s, count(*) AS c, count(*) FILTER (d > 0) AS up FROM y GROUP BY abs(d)), r AS (SELECT *, sum(c) OVER (ORDER BY s) - (c - 1) / 2.0 AS rk FROM c)
  SELECT sum(c)::BIGINT AS n, sum(rk * up)::DOUBLE AS w_plus, sum(rk * (c - up))::DOUBLE AS w_minus FROM r""")
def m08(spark, d):
    e = v.base(spark, d, "events")
    x = e.groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("before"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("after"))
    return t.signed_ranks(x.withColumn("after", F.round(F.col("after") - F.col("before"), 9)).withColumn("before", F.lit(0.0)), "before", "after")


@query("m11_perf_report_filter", "SELECT tenant_id, count(*) AS n, sum(duration_ms)::BIGINT AS total FROM {timings} WHERE tenant_id IN ('t0', 't1', 't2') GROUP BY tenant_id ORDER BY total DESC, tenant_id")
def m11(spark, d):
    return v.timings(spark, d).where(F.col("tenant_id").isin("t0", "t1", "t2")).groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total")).orderBy(F.desc("total"), "tenant_id")


@query("d05_mean_processing_time", "SELECT round(avg(s), 6) AS mean_ms FROM (SELECT queue_id, sum(duration_ms) AS s FROM {timings} GROUP BY queue_id)")
def d05(spark, d):
    return v.timings(spark, d).groupBy("queue_id").agg(F.sum("duration_ms").alias("s")).agg(F.round(F.avg("s"), 6).alias("mean_ms"))


@query("d06_queue_health", """WITH x AS (SELECT tenant_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, date_diff('day', min(created_at) FILTER (status = 'pending'), (SELECT max(created_at) FROM queue)) AS age FROM {queue} GROUP BY tenant_id)
  SELECT tenant_id, pending, failed, CASE greatest(CASE WHEN pending >= 50 THEN 2 WHEN pending >= 20 THEN 1 ELSE 0 END, CASE WHEN failed >= 10 THEN 2 WHEN failed >= 1 THEN 1 ELSE 0 END, CASE WHEN age > 2500 THEN 2 WHEN age > 1000 THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS health FROM x""")
def d06(spark, d):
    q = v.queue(spark, d)
    x = q.groupBy("tenant_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.min(F.when(F.col("status") == "pending", F.col("created_at"))).alias("oldest"))
    x = with_value(x, q.agg(F.max("created_at").alias("as_of")))
    level = lambda c, high, low: F.when(c >= high, 2).when(c >= low, 1).otherwise(0)
    age = F.datediff(F.col("as_of").cast("date"), F.col("oldest").cast("date"))
    worst = F.greatest(level(F.col("pending"), 50, 20), level(F.col("failed"), 10, 1), level(F.coalesce(age, F.lit(0)), 2501, 1001))
    return x.select("tenant_id", "pending", "failed", F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("ok").alias("health"))


@query("d15_zero_filled_grid", "WITH a AS (SELECT DISTINCT item_type FROM {queue}), b AS (SELECT unnest(['pending', 'in_progress', 'done', 'failed']) AS status), c AS (SELECT item_type, status, count(*) AS n FROM queue GROUP BY ALL) SELECT a.item_type, b.status, coalesce(n, 0) AS n FROM a CROSS JOIN b LEFT JOIN c USING (item_type, status)")
def d15(spark, d):
    q = v.queue(spark, d)
    states = spark.createDataFrame([(s,) for s in ("pending", "in_progress", "done", "failed")], "status string")
    return t.zero_filled(q, q.select("item_type").distinct(), states, ["item_type", "status"])


@query("d17_queue_listing", "SELECT queue_id, item_type, op, created_at FROM {queue} WHERE status = 'pending' AND item_type = 'file' ORDER BY created_at, queue_id LIMIT 25")
def d17(spark, d):
    return v.queue(spark, d).where("status = 'pending' and item_type = 'file'").select("queue_id", "item_type", "op", "created_at").orderBy("created_at", "queue_id").limit(25)


@query("d20_indexing_progress", "SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, round(100.0 * count(*) FILTER (status = 'done') / count(*), 1)::DOUBLE AS pct FROM {queue} GROUP BY tenant_id")
def d20(spark, d):
    return v.queue(spark, d).groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done")).withColumn("pct", F.round(100.0 * F.col("done") / F.col("total"), 1))


@query("d22_live_sessions", "SELECT project_id, count(DISTINCT session_id) AS sessions FROM {search_events} WHERE ts > (SELECT max(ts) FROM search_events) - INTERVAL 48 HOUR GROUP BY project_id")
def d22(spark, d):
    e = v.search_events(spark, d)
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of"))), F.col("ts") > F.col("as_of") - F.expr("INTERVAL 48 HOURS"))
    return recent.groupBy("project_id").agg(F.countDistinct("session_id").alias("sessions"))


@query("d23_requeue_candidates", "SELECT queue_id, tenant_id, error_message FROM {queue} WHERE status = 'failed' AND error_message LIKE '%refused%'")
def d23(spark, d):
    return v.queue(spark, d).where((F.col("status") == "failed") & F.col("error_message").contains("refused")).select("queue_id", "tenant_id", "error_message")
