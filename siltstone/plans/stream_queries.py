"""Queries of ingest operators, in their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans._registry import Registry
from siltstone.sources import views as v
from siltstone.streaming import ingest as s
from siltstone.streaming import leases

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("x01_debounce", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
  SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k""")
def x01(spark, d):
    e = v.base(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return s.debounced(e, "user_id", "ts", "2 hours", "event_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _file_events(spark, d):
    e = v.base(spark, d, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "removed").otherwise("created")
    path = F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"), F.lit("/f"), F.col("event_id").cast("string"))
    return e.select((F.col("user_id") % 40).alias("file_id"), "ts", kind.alias("kind"), path.alias("path"))


@query("x02_moves", """WITH f AS (SELECT user_id % 40 AS file_id, ts, event_id % 2 = 0 AS gone, 'd' || (event_id % 3) || '/f' || event_id AS path FROM events), m AS (SELECT a.path AS fp, b.path AS tp, a.file_id, a.ts AS ta, b.ts AS tb, epoch_us(b.ts) - epoch_us(a.ts) AS gap FROM f a JOIN f b USING (file_id) WHERE a.gone AND NOT b.gone AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 36000000000),
  p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY file_id, fp, ta ORDER BY gap, fp, tp) = 1), q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY file_id, tp, tb ORDER BY gap, fp, tp) = 1)
  SELECT fp AS from_path, tp AS to_path, CASE WHEN string_split(fp, '/')[1] = string_split(tp, '/')[1] THEN 'rename' ELSE 'move' END AS kind FROM q""")
def x02(spark, d):
    return s.moves(_file_events(spark, d), 36_000)


@query("x02b_folder_moves", """WITH f AS (SELECT event_id % 5 = 0 AS folder, CASE WHEN event_id % 5 > 0 THEN user_id END AS file_id, ts, event_id % 2 = 0 AS gone, 'd' || (event_id % 3) || '/f' || (event_id % 500) AS path FROM events), i AS (SELECT *, coalesce('id ' || file_id, CASE WHEN folder THEN 'name ' || string_split(path, '/')[2] END) AS k FROM f),
  m AS (SELECT a.path AS fp, b.path AS tp, k, a.ts AS ta, b.ts AS tb, epoch_us(b.ts) - epoch_us(a.ts) AS gap FROM i a JOIN i b USING (k) WHERE a.gone AND NOT b.gone AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 360000000000),
  p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, fp, ta ORDER BY gap, fp, tp) = 1), q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k, tp, tb ORDER BY gap, fp, tp) = 1)
  SELECT fp AS from_path, tp AS to_path, CASE WHEN string_split(fp, '/')[1] = string_split(tp, '/')[1] THEN 'rename' ELSE 'move' END AS kind FROM q""")
def x02b(spark, d):
    """Every fifth event is of a folder, which has no id and is known by its name."""
    e = v.base(spark, d, "events")
    path = F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"), F.lit("/f"), (F.col("event_id") % 500).cast("string"))
    folder = F.col("event_id") % 5 == 0
    files = e.select(F.when(~folder, F.col("user_id")).alias("file_id"), "ts", F.when(F.col("event_id") % 2 == 0, "removed").otherwise("created").alias("kind"), path.alias("path"), folder.alias("folder"))
    return s.moves(files, 360_000, is_folder="folder")


@query("x03_bounded_buffer", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def x03(spark, d):
    return s.newest(v.base(spark, d, "events").select("event_id", "user_id", "ts"), 3, [F.desc("ts"), F.desc("event_id")], "user_id").select("event_id")


@query("x04_load_levels", "SELECT tenant_id, count(*) * 20 AS depth, CASE WHEN count(*) * 20 >= 5000 THEN 'critical' WHEN count(*) * 20 >= 1000 THEN 'high' ELSE 'normal' END AS level, CASE WHEN count(*) * 20 >= 5000 THEN 5 WHEN count(*) * 20 >= 1000 THEN 25 ELSE 250 END AS released FROM {queue} GROUP BY tenant_id")
def x04(spark, d):
    q = v.queue(spark, d).groupBy("tenant_id").agg((F.count("*") * 20).alias("depth")).withColumn("level", s.load_level(F.col("depth")))
    return q.withColumn("released", s.release_per_tick(F.col("level")))


@query("x05_idempotent_enqueue", "SELECT tenant_id, item_type, op, min(queue_id) AS queue_id FROM {queue} GROUP BY ALL")
def x05(spark, d):
    return s.unique_items(v.queue(spark, d), ["tenant_id", "item_type", "op"], ["queue_id"]).select("tenant_id", "item_type", "op", "queue_id")


@query("x06_claimable", "WITH q AS (SELECT queue_id, CASE WHEN queue_id % 7 = 0 THEN 'in_progress' ELSE status END AS status, created_at + INTERVAL 1 DAY AS lease FROM {queue}) SELECT queue_id FROM q WHERE status = 'pending' OR (status = 'in_progress' AND lease < TIMESTAMP '1996-01-01')")
def x06(spark, d):
    q = v.queue(spark, d).withColumn("status", F.when(F.col("queue_id") % 7 == 0, "in_progress").otherwise(F.col("status"))).withColumn("lease_until", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return s.claimable(q, F.lit("1996-01-01").cast("timestamp_ntz")).select("queue_id")


@query("x06b_lease_history", """WITH RECURSIVE c AS (SELECT DISTINCT user_id AS item_id, epoch_us(ts) // 1000 AS at_ms FROM events),
  g AS (SELECT item_id, min(at_ms) AS at_ms FROM c GROUP BY item_id UNION ALL SELECT c.item_id, min(c.at_ms) FROM g JOIN c ON c.item_id = g.item_id AND c.at_ms > g.at_ms + 86400000 GROUP BY c.item_id)
  SELECT item_id, at_ms, at_ms + 86400000 AS lease_until_ms FROM g""")
def x06b(spark, d):
    """Every event claims its user's item for a day: which claims are granted."""
    claims = v.base(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("id"), F.lit("claim").alias("kind"), F.lit("w").alias("worker"), F.col("ts").cast("timestamp").alias("at"))
    return leases.lease_history(claims, 86_400).where("outcome = 'granted'").select("item_id", "at_ms", "lease_until_ms")


@query("k05_priority_order", "SELECT queue_id FROM {queue} WHERE status = 'pending' ORDER BY CASE WHEN date_diff('day', CAST(created_at AS DATE), DATE '1998-08-02') > 2000 THEN 0 ELSE priority END, CASE WHEN op = 'delete' THEN 0 ELSE 1 END, retry_count, created_at, queue_id LIMIT 40")
def k05(spark, d):
    q = v.queue(spark, d).where("status = 'pending'")
    return s.prioritised(q, 40, promote_after_days=2000, as_of=F.lit("1998-08-02")).select("queue_id")


@query("x07_fair_turns", "WITH n AS (SELECT queue_id, priority <= 2 AS u, row_number() OVER (PARTITION BY priority <= 2 ORDER BY created_at, queue_id) - 1 AS n FROM {queue} WHERE status = 'pending') SELECT queue_id, row_number() OVER (ORDER BY n // CASE WHEN u THEN 10 ELSE 3 END, u DESC, n)::INTEGER AS place FROM n QUALIFY place <= 130")
def x07(spark, d):
    return s.fair_turns(v.queue(spark, d).where("status = 'pending'")).select("queue_id", "place")


@query("x08_best_per_group", "SELECT queue_id FROM {queue} WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY tenant_id, item_type ORDER BY priority, created_at, queue_id) <= 2")
def x08(spark, d):
    return s.best_per_group(v.queue(spark, d).where("status = 'pending'"), ["tenant_id", "item_type"], 2).select("queue_id")


@query("x09_triage", "SELECT queue_id, CASE WHEN contains(error_message, 'not found') THEN 'drop' WHEN regexp_matches(error_message, 'refused|timeout|locked') AND retry_count < 3 THEN 'retry' ELSE 'dead' END AS verdict FROM {queue} WHERE status = 'failed'")
def x09(spark, d):
    return s.triaged(v.queue(spark, d)).select("queue_id", "verdict")


@query("x10_breaker", """WITH RECURSIVE o AS (SELECT (user_id % 20)::VARCHAR AS key, event_id AS id, value < 60 AS ok, epoch_us(ts::TIMESTAMP) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_us(ts::TIMESTAMP), event_id) AS n FROM events),
  s AS (SELECT key, 0::BIGINT AS n, 0::BIGINT AS id, 0.0::DOUBLE AS sec, 0 AS run, 0 AS good, 0 AS level, -1.0::DOUBLE AS until FROM (SELECT DISTINCT key FROM o) UNION ALL
    SELECT o.key, o.n, o.id, o.sec, CASE WHEN NOT o.ok THEN s.run + 1 WHEN s.good + 1 >= 3 THEN 0 ELSE s.run END, CASE WHEN o.ok THEN s.good + 1 ELSE 0 END,
      CASE WHEN NOT o.ok THEN s.level + 1 WHEN s.good + 1 >= 3 THEN 0 ELSE greatest(0, s.level - 1) END, CASE WHEN o.ok THEN CASE WHEN s.good + 1 >= 3 THEN -1.0 ELSE s.until END WHEN s.run + 1 >= 20 THEN o.sec + 3600.0 ELSE s.until END
    FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
  SELECT key, id, CASE WHEN until >= 0 THEN CASE WHEN sec < until THEN 'disabled' ELSE 'half_open' END WHEN run >= 5 THEN 'backoff' WHEN run >= 3 THEN 'degraded' ELSE 'healthy' END AS status,
    CASE WHEN until >= 0 THEN CASE WHEN sec < until THEN until - sec ELSE 0 END WHEN run >= 5 THEN least(300.0, pow(2.0, least(level, 60))) ELSE 0 END::DOUBLE AS delay_s FROM s WHERE n > 0""")
def x10(spark, d):
    e = v.base(spark, d, "events")
    rows = e.select((F.col("user_id") % 20).cast("string").alias("key"), F.col("event_id").alias("id"), (F.col("value") < 60).alias("ok"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return s.breaker_batch(rows)


@query("x12_destination_status", "SELECT queue_id, CASE WHEN queue_id % 5 = 0 OR queue_id % 7 = 0 THEN 'failed' WHEN queue_id % 2 = 0 AND queue_id % 3 = 0 THEN 'done' ELSE 'in_progress' END AS final FROM {queue}")
def x12(spark, d):
    k = F.col("queue_id")
    one = F.when(k % 5 == 0, "failed").when(k % 2 == 0, "done").otherwise("pending")
    two = F.when(k % 7 == 0, "failed").when(k % 3 == 0, "done").otherwise("pending")
    return v.queue(spark, d).select("queue_id", s.final_status(one, two).alias("final"))


@query("x13_incremental_skip", "SELECT file_id FROM {files} WHERE file_id % 4 = 0 OR file_id % 9 = 0")
def x13(spark, d):
    f = v.files(spark, d).select("file_id", "file_path", "file_hash")
    known = f.where("file_id % 4 <> 0").select("file_path", F.when(F.col("file_id") % 9 == 0, "old").otherwise(F.col("file_hash")).alias("file_hash"))
    return s.changed_files(f, known).select("file_id")
