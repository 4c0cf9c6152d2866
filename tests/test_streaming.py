"""Streaming forms give what the batch forms give on the same rows."""

from pyspark.sql import functions as F

from siltstone.streaming import ingest as s


def _source(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _events(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    return e.select("event_id", F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def test_rollup_stream(spark, data, tmp_path):
    e = _events(spark, data)
    last = spark.createDataFrame([(10**9, 0, "2030-01-01 00:00:00", "view", 1.0)], "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    src = _source(spark, e.unionByName(last), str(tmp_path / "in"))
    got = s.drained(s.rolled_up_stream(src, "event_type", "ts", "value", "1 day", "1 hour"), "rolled", str(tmp_path / "c"))
    want = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
    assert sorted(map(tuple, got.select("event_type", "start", "n").collect())) == sorted(map(tuple, want.collect()))


def test_debounce_stream(spark, data, tmp_path):
    e = _events(spark, data).select("event_id", "user_id", "ts")
    last = spark.createDataFrame([(10**9, 10**6, "2030-01-01 00:00:00")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = _source(spark, e.unionByName(last), str(tmp_path / "in"))
    got = s.drained(s.debounced_stream(src, "user_id", "ts", "2 hours", "1 hour", "event_id"), "quiet", str(tmp_path / "c"))
    want = s.debounced(e, "user_id", "ts", "2 hours", "event_id")
    assert sorted(map(tuple, got.where("user_id < 1000000").collect())) == sorted(map(tuple, want.collect()))


def test_unique_stream(spark, data, tmp_path):
    e = _events(spark, data).select("user_id", "ts")
    src = _source(spark, e.unionByName(e), str(tmp_path / "in"))
    got = s.drained(s.unique_stream(src, ["user_id"], "ts", "90 days"), "once", str(tmp_path / "c"))
    assert got.count() == e.select("user_id").distinct().count()


def test_breaker_stream(spark, data, tmp_path):
    e = _events(spark, data)
    rows = e.select((F.col("user_id") % 5).cast("string").alias("key"), F.col("event_id").alias("id"), (F.col("value") < 60).alias("ok"), F.col("event_id").cast("double").alias("at"))
    got = s.drained(s.breaker_stream(_source(spark, rows.coalesce(1), str(tmp_path / "in"))), "breaker", str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, s.breaker_batch(rows).collect()))


def test_breaker_rules():
    b = s.Breaker(degraded=2, back_off=3, disable=4, cool_s=10, heal=2)
    assert b.step(False, 0) == ("healthy", 0.0)
    assert b.step(False, 1) == ("degraded", 0.0)
    assert b.step(False, 2) == ("backoff", 8.0)
    assert b.step(False, 3) == ("disabled", 10.0)
    assert b.step(True, 20)[0] == "half_open"
    assert b.step(True, 21) == ("healthy", 0.0)
