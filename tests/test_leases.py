"""Leases by hand and over a stream with timers against the table form; a writer that counts batches once."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.streaming import ingest as s
from siltstone.streaming import leases as ls


def test_rules_by_hand():
    x = ls.Lease()
    assert x.step("claim", "a", 0, 100) == [(0, "a", "granted", 100)]
    assert x.step("claim", "b", 50, 100) == [(50, "b", "refused", None)]
    assert x.step("renew", "b", 60, 100) == [(60, "b", "ignored", None)]
    assert x.step("renew", "a", 60, 100) == [(60, "a", "renewed", 160)]
    assert x.step("claim", "b", 160, 100) == [(160, "b", "refused", None)]
    assert x.step("claim", "b", 161, 100) == [(160, "a", "expired", None), (161, "b", "granted", 261)]
    assert x.step("done", "a", 200, 100) == [(200, "a", "ignored", None)]
    assert x.step("done", "b", 270, 100) == [(261, "b", "expired", None), (270, "b", "ignored", None)]  # too late: anybody's again
    assert x.step("claim", None, 271, 100) == [(271, None, "refused", None)]
    assert x.step("claim", "c", 272, 100) == [(272, "c", "granted", 372)]
    assert x.step("release", "c", 273, 100) == [(273, "c", "released", None)]
    assert x.step("claim", "d", 273, 100) == [(273, "d", "granted", 373)] and x.step("done", "d", 280, 100) == [(280, "d", "done", None)]
    assert x.step("claim", "e", 9_999, 100) == [(9_999, "e", "refused", None)] and x.expired(10**9) == []


def _claims(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    kind = F.when(F.col("event_id") % 11 == 0, "done").when(F.col("event_id") % 7 == 0, "renew").when(F.col("event_id") % 13 == 0, "release").otherwise("claim")
    worker = F.when(F.col("event_id") % 17 > 0, F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")))
    return e.select((F.col("user_id") % 40).alias("item_id"), F.col("event_id").alias("id"), kind.alias("kind"), worker.alias("worker"), F.col("ts").cast("timestamp").alias("at"))


def test_stream_gives_what_the_table_gives(spark, data, tmp_path):
    ls.with_timers(spark)
    rows = _claims(spark, data).orderBy("at", "id")
    last = spark.createDataFrame([(10**6, 10**9, "claim", "w", "2100-01-01 00:00:00")], "item_id long, id long, kind string, worker string, at string").withColumn("at", F.to_timestamp("at"))
    # in order of time, a file a batch; the last event moves the watermark past all leases
    parts = rows.withColumn("n", F.ntile(4).over(W.orderBy("at", "id"))).cache()
    src = str(tmp_path / "in")
    for n in range(1, 5):
        parts.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(src)
    last.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = s.drained(ls.lease_stream(stream, 3600 * 12), "leases", str(tmp_path / "c")).where("item_id < 1000000")
    want = ls.lease_history(rows, 3600 * 12, now_ms=4_102_444_800_000)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    assert {r.outcome for r in want.select("outcome").distinct().collect()} == {"granted", "refused", "renewed", "released", "done", "expired", "ignored"}
    assert ls.lease_history(rows.where("false")).count() == 0


def test_writer_counts_batches_once(spark, tmp_path):
    out, schema = f"file://{tmp_path}/out", "id long"
    src = str(tmp_path / "in")
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    assert ls.batches_of(spark, out, schema).count() == 0
    ls.batched_writer(stream(), out, str(tmp_path / "c"), None).awaitTermination()
    assert sorted(r.id for r in ls.batches_of(spark, out, schema).collect()) == list(range(30))
    # the same batches again, as after a lost checkpoint, with other rows: nothing is written twice
    ls.write_batch(spark.range(900, 910), 1, out)
    assert sorted(r.id for r in ls.batches_of(spark, out, schema).collect()) == list(range(30))
    # a batch that broke before its note is not read, and is written over
    spark.range(500, 505).write.parquet(f"{out}/batches/batch=7")
    assert ls.batches_of(spark, out, schema).count() == 30
    ls.write_batch(spark.range(600, 601), 7, out)
    assert sorted(r.id for r in ls.batches_of(spark, out, schema).where("batch = 7").collect()) == [600]
    running = ls.batched_writer(stream(), f"file://{tmp_path}/timed", str(tmp_path / "t"))
    running.processAllAvailable()
    running.stop()
    assert ls.batches_of(spark, f"file://{tmp_path}/timed", schema).count() == 30


@pytest.mark.parametrize("lease_s", [1, 86_400])
def test_claims_alone_are_granted_one_lease_apart(spark, data, lease_s):
    rows = _claims(spark, data).withColumn("kind", F.lit("claim")).withColumn("worker", F.lit("w"))
    last: dict = {}
    for r in ls.lease_history(rows, lease_s).where("outcome = 'granted'").orderBy("item_id", "at_ms").collect():
        assert r.item_id not in last or r.at_ms > last[r.item_id]
        last[r.item_id] = r.lease_until_ms
