"""Ingest semantics over event streams: batch forms, and Structured Streaming forms of the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def debounced(events: DataFrame, key: str, ts: str, quiet: str, id: str) -> DataFrame:
    """One row for each burst of a key that ends with `quiet` without events: its last event, start and number of events. Batch or stream (append, with a watermark on `ts`)."""
    burst = events.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n"), F.max(F.struct(ts, id)).alias("last"))
    return burst.select(key, F.col(f"last.{id}").alias(id), F.col("w.start").alias("start"), "n")


def debounced_stream(events: DataFrame, key: str, ts: str, quiet: str, late: str, id: str) -> DataFrame:
    return debounced(events.withWatermark(ts, late), key, ts, quiet, id)


def moves(events: DataFrame, within_s: int, id: str = "file_id", ts: str = "ts", is_folder: str | None = None) -> DataFrame:
    """from_path, to_path, kind for each removal that is followed within `within_s` by a creation of the same file: rename in one folder, else move. Each event is used once: the nearest creation, the nearest removal.

    Folders without an id, where `is_folder` tells which rows are folders, are the same if they have the same name; other rows without an id have no partner.
    """
    name = F.regexp_extract("path", r"([^/]*)/?$", 1)
    same = F.concat(F.lit("id "), F.col(id).cast("string")) if is_folder is None else F.coalesce(F.concat(F.lit("id "), F.col(id).cast("string")), F.when(F.col(is_folder), F.concat(F.lit("name "), name)))
    known = events.where("kind in ('removed', 'created')").select(same.alias("_id"), "path", F.col(ts).alias("t"), (F.col("kind") == "removed").alias("gone")).where("_id is not null and t is not null")
    # latest first, so the least creation so far is the next one: events of a file are never paired
    next_ = F.min(F.when(~F.col("gone"), F.struct(F.col("t").alias("b"), F.col("path").alias("to_path")))).over(W.partitionBy("_id").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, 0))
    met = known.withColumn("_n", next_).where("gone and _n is not null").select("_id", F.col("path").alias("from_path"), "_n.to_path", "_n.b", F.timestamp_diff("MICROSECOND", F.col("t"), F.col("_n.b")).alias("_gap"))
    met = met.where(F.col("_gap") <= within_s * 1_000_000)
    met = met.withColumn("_r", F.row_number().over(W.partitionBy("_id", "to_path", "b").orderBy("_gap", "from_path"))).where("_r = 1")
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    return met.select("from_path", "to_path", F.when(folder("from_path") == folder("to_path"), "rename").otherwise("move").alias("kind"))


def newest(events: DataFrame, cap: int, order: list, by: str) -> DataFrame:
    """The last `cap` events of each buffer; older ones are dropped, as a bounded buffer does."""
    w = W.partitionBy(by).orderBy(*order)
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def load_level(depth: Column) -> Column:
    return F.when(depth >= 5000, "critical").when(depth >= 1000, "high").otherwise("normal")


def release_per_tick(level: Column) -> Column:
    """How many deferred items a tick lets go."""
    return F.when(level == "critical", 5).when(level == "high", 25).otherwise(250)


def unique_items(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first item of each key."""
    return items.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def unique_stream(items: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first item of each key within the watermark; state is dropped behind it."""
    return items.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def claimable(queue: DataFrame, now: Column) -> DataFrame:
    """Pending items, and those in progress whose lease has run out."""
    return queue.where((F.col("status") == "pending") | ((F.col("status") == "in_progress") & (F.col("lease_until") < now)))


def prioritised(queue: DataFrame, batch: int, *, oldest_first: bool = True, promote_after_days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """The next `batch` items: by priority (old ones are promoted), deletions before other operations, fewer retries, age, id."""
    p = F.col("priority")
    if promote_after_days is not None and as_of is not None:
        p = F.when(F.datediff(as_of.cast("date"), F.col("created_at").cast("date")) > promote_after_days, F.lit(0)).otherwise(p)
    age = F.col("created_at").asc() if oldest_first else F.col("created_at").desc()
    return queue.withColumn("rank_priority", p).orderBy("rank_priority", F.when(F.col("op") == "delete", 0).otherwise(1), "retry_count", age, "queue_id").limit(batch)


def fair_turns(queue: DataFrame, high: int = 10, low: int = 3, limit: int = 130) -> DataFrame:
    """Items in turns of `high` urgent ones and `low` others, each in order of age; place is the position."""
    urgent = F.col("priority") <= 2
    n = F.row_number().over(W.partitionBy("_u").orderBy("created_at", "queue_id"))
    x = queue.withColumn("_u", urgent).withColumn("_r", n)
    size = F.when(F.col("_u"), high).otherwise(low)
    # each task keeps its own first `limit` before any rows move
    x = x.where(F.col("_r") <= limit).withColumn("_n", F.col("_r") - 1).drop("_r").withColumn("_turn", F.floor(F.col("_n") / size))
    return x.withColumn("place", F.row_number().over(W.orderBy("_turn", F.desc("_u"), "_n"))).where(F.col("place") <= limit).drop("_u", "_n", "_turn")


def best_per_group(queue: DataFrame, groups: list[str], batch: int) -> DataFrame:
    w = W.partitionBy(*groups).orderBy("priority", "created_at", "queue_id")
    return queue.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= batch).drop("_r")


def triaged(queue: DataFrame, most: int = 3) -> DataFrame:
    """Failed items as retry (fewer than `most` attempts and a passing error), drop (the file is gone) or dead."""
    passing = F.col("error_message").rlike("refused|timeout|locked")
    verdict = F.when(F.col("error_message").contains("not found"), "drop").when(passing & (F.col("retry_count") < most), "retry").otherwise("dead")
    return queue.where("status = 'failed'").withColumn("verdict", verdict)


def final_status(first: Column, second: Column) -> Column:
    """failed if either store failed, done if both are done, else in progress."""
    return F.when((first == "failed") | (second == "failed"), "failed").when((first == "done") & (second == "done"), "done").otherwise("in_progress")


def changed_files(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not known for their path."""
    return seen.join(known, ["file_path", "file_hash"], "left_anti")


_STATE = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("good", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("open_until", T.DoubleType())])
_OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("delay_s", T.DoubleType())])


class Breaker:
    """Back-off and circuit breaker of one key: errors in a row degrade, back off and at last open it; open ends after `cool_s`; `heal` successes reset it, each lowers the level by one."""

    def __init__(self, run: int = 0, good: int = 0, level: int = 0, open_until: float = -1.0, *, degraded: int = 3, back_off: int = 5, disable: int = 20, base_s: float = 1.0, most_s: float = 300.0, cool_s: float = 3600.0, heal: int = 3) -> None:
        self.run, self.good, self.level, self.open_until = run, good, level, open_until
        self.limits = (degraded, back_off, disable)
        self.base_s, self.most_s, self.cool_s, self.heal = base_s, most_s, cool_s, heal

    def step(self, ok: bool, at: float) -> tuple[str, float]:
        """Status and delay after an outcome at second `at`."""
        if ok:
            self.good, self.level = self.good + 1, max(0, self.level - 1)
            if self.good >= self.heal:
                self.run, self.level, self.open_until = 0, 0, -1.0
        else:
            self.run, self.good, self.level = self.run + 1, 0, self.level + 1
            if self.run >= self.limits[2]:
                self.open_until = at + self.cool_s
        if self.open_until >= 0:
            return ("disabled", self.open_until - at) if at < self.open_until else ("half_open", 0.0)
        if self.run >= self.limits[1]:
            return "backoff", min(self.most_s, self.base_s * 2.0 ** min(self.level, 60))
        return ("degraded" if self.run >= self.limits[0] else "healthy"), 0.0


def breaker_batch(events: DataFrame, **limits) -> DataFrame:
    """key, id, status, delay_s after each outcome (key string, id long, ok boolean, at double) in order of time. A key's events are one group, as its state is one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Breaker(**limits)
        pdf = pdf.sort_values(["at", "id"], kind="stable")
        rows = [(k, int(i), *b.step(bool(o), float(a))) for k, i, o, a in zip(pdf["key"], pdf["id"], pdf["ok"], pdf["at"], strict=True)]
        return pd.DataFrame(rows, columns=["key", "id", "status", "delay_s"])

    return events.select("key", "id", "ok", "at").groupBy("key").applyInPandas(run, _OUT)


def breaker_stream(events: DataFrame, **limits) -> DataFrame:
    """breaker_batch over a stream: the state of each key is four numbers."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = Breaker(*(state.get if state.exists else (0, 0, 0, -1.0)), **limits)
        rows = []
        for pdf in batches:
            pdf = pdf.sort_values(["at", "id"], kind="stable")
            rows += [(key[0], int(i), *b.step(bool(o), float(a))) for i, o, a in zip(pdf["id"], pdf["ok"], pdf["at"], strict=True)]
        state.update((b.run, b.good, b.level, b.open_until))
        yield pd.DataFrame(rows, columns=["key", "id", "status", "delay_s"])

    return events.select("key", "id", "ok", "at").groupBy("key").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")


def rolled_up_stream(events: DataFrame, key: str, ts: str, value: str, width: str, late: str) -> DataFrame:
    """Count and mean by tumbling window, emitted once the watermark has passed the window."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "mean")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives now, through a memory table; for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
