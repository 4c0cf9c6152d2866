"""Leases on queue items: who may work on what and until when, over a stream with timers and over a table; and a writer whose batches count once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.sources.store import exists

#: Seconds that a lease lasts. Fixed value.
LEASE_S = 300
_OUT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("worker", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("lease_until_ms", T.LongType())])
_STATE = "worker string, until_ms long, done boolean"


class Lease:
    """One item: nobody's, or a worker's until a time, or done."""

    def __init__(self, worker: str | None = None, until_ms: int = -1, done: bool = False) -> None:
        self.worker, self.until_ms, self.done = worker, until_ms, done

    def expired(self, now_ms: int) -> list[tuple]:
        """What runs out before `now_ms`: the item is anybody's again."""
        if self.worker is None or self.done or self.until_ms >= now_ms:
            return []
        out = [(self.until_ms, self.worker, "expired", None)]
        self.worker = None
        return out

    def step(self, kind: str, worker: str | None, at_ms: int, lease_ms: int) -> list[tuple]:
        """(time, worker, outcome, lease until) of an event: a claim is granted where nobody holds the item or its lease ran out before, and refused else; its holder renews, gives back or finishes it, anybody else is ignored."""
        out = self.expired(at_ms)
        mine = not self.done and self.worker is not None and worker == self.worker
        if kind == "claim" and worker is not None and not self.done and self.worker is None:
            self.worker, self.until_ms = worker, at_ms + lease_ms
            return [*out, (at_ms, worker, "granted", self.until_ms)]
        if kind == "renew" and mine:
            self.until_ms = at_ms + lease_ms
            return [*out, (at_ms, worker, "renewed", self.until_ms)]
        if kind in ("done", "release") and mine:
            self.done, self.worker = kind == "done", None
            return [*out, (at_ms, worker, "done" if self.done else "released", None)]
        return [*out, (at_ms, worker, "refused" if kind == "claim" else "ignored", None)]


def _ordered(pdf: pd.DataFrame) -> Iterator[tuple]:
    pdf = pdf.sort_values(["at_ms", "id"], kind="stable")
    return zip(pdf["kind"], [w if isinstance(w, str) else None for w in pdf["worker"]], map(int, pdf["at_ms"]), strict=True)


def _frame(item: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(item, *r) for r in rows], columns=_OUT.names)
    return out.astype({"item_id": "int64", "at_ms": "int64", "lease_until_ms": "Int64"})


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("item_id").cast("long"), "id", "kind", "worker", F.unix_millis("at").alias("at_ms"), "at")


def lease_history(events: DataFrame, lease_s: int = LEASE_S, now_ms: int | None = None) -> DataFrame:
    """item_id, at_ms, worker, outcome, lease_until_ms of all `events` (item_id, id, kind, worker, at timestamp) in order of time and id; kinds are claim, renew, release and done.

    Leases that run out before the next event of the item, or before `now_ms`, are outcomes too. An item's events are one group, as its state is one: events of one item are few.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lease = Lease()
        rows = [r for e in _ordered(pdf) for r in lease.step(*e, lease_s * 1000)]
        return _frame(key[0], rows + (lease.expired(now_ms) if now_ms is not None else []))

    return _events(events).drop("at").groupBy("item_id").applyInPandas(run, _OUT)


class _Leases(StatefulProcessor):
    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", _STATE)

    def _lease(self) -> Lease:
        return Lease(*self.state.get()) if self.state.exists() else Lease()

    def _keep(self, lease: Lease) -> None:
        # one timer for each item: that of its lease, if somebody holds it; it fires once the watermark is past it
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lease.worker is not None:
            self.handle.registerTimer(lease.until_ms + 1)
        if lease.worker is None and not lease.done:
            self.state.clear()
        else:
            self.state.update((lease.worker, lease.until_ms, lease.done))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lease, out = self._lease(), []
        for event in _ordered(pd.concat(list(rows))):
            out += lease.step(*event, self.lease_ms)
        self._keep(lease)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = self._lease()
        out = lease.expired(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(lease)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease_s: int = LEASE_S, late: str = "0 seconds") -> DataFrame:
    """lease_history() over a stream whose events come in order of time for each item: an item's state is its holder and the lease's end, and is dropped when it is nobody's; a timer ends leases that no event ends.

    The session needs the state store of RocksDB: see with_timers().
    """
    marked = _events(events.withWatermark("at", late))
    return marked.groupBy("item_id").transformWithStateInPandas(_Leases(lease_s * 1000), _OUT, "append", "eventTime")


def with_timers(spark: SparkSession) -> None:
    """Stream states of this session are kept in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch below `path` in the folder of its number, then notes the number in a ledger: for foreachBatch.

    A batch that is in the ledger is not written again. One that broke before its note is written over when the stream comes back, and until then is not read, so each
    batch counts once.
    """
    spark = df.sparkSession
    if batch_id in _noted(spark, path):
        return
    df.write.mode("overwrite").parquet(f"{path}/batches/batch={int(batch_id)}")
    spark.createDataFrame([(int(batch_id),)], "batch long").coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def _noted(spark: SparkSession, path: str) -> set[int]:
    return {r.batch for r in spark.read.schema("batch long").parquet(f"{path}/ledger").collect()} if exists(spark, f"{path}/ledger") else set()


def batches_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the batches in the ledger, with the number of each."""
    paths = [f"{path}/batches/batch={b}" for b in sorted(_noted(spark, path))]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("int"))
    return spark.read.option("basePath", f"{path}/batches").parquet(*paths)


def batched_writer(stream: DataFrame, path: str, checkpoint: str, every: str | None = "500 milliseconds"):
    """A running query that writes `stream` in batches: one each time `every` has passed, or, with None, all there is now and then an end. How many rows a batch takes is the source's limit (maxFilesPerTrigger and its like)."""
    writer = stream.writeStream.foreachBatch(lambda df, number: write_batch(df, number, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
