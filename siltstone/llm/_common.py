"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.store import cut, drop_table, new_place, remove, shared_dir

__all__ = ["ALNUM", "attached", "blobs", "bucketed", "drop_table", "new_place", "pieces", "placed", "read", "released", "remove", "shared_dir", "table", "without"]

#: Byte table that lower-cases A-Z and turns every ASCII byte but 0-9 and letters into a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


#: Most buckets that a table is written in.
MOST_BUCKETS = 50_000


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    return cut(df, name)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, forget: bool = False) -> DataFrame:
    """As table(), in buckets by `key`: what is grouped or joined by `key` later meets `df` without moving it. With `forget` the session's catalogue knows the table only until its plan is made."""
    spark, place = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = new_place(spark, name)
    df.write.bucketBy(max(1, min(buckets, MOST_BUCKETS)), key).option("path", path).saveAsTable(place)
    out = spark.table(place)
    if forget:
        spark.sql(f"DROP TABLE {place}")
    out.stored_at = path
    return out


def placed(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """`df` with its columns named c0, c1 and so on, which no name that an operator adds is like; those names by the columns' own in lower case, and the columns under their own names again."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), {c.lower(): n for n, c in zip(names, df.columns, strict=True)}, [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def without(columns: list[str], backs: list[Column], added: tuple[str, ...]) -> list[Column]:
    """Those of `backs` whose names, `columns`, are not among the names that are added."""
    return [b for c, b in zip(columns, backs, strict=True) if c.lower() not in added]


#: A group with more than one row in so many is met by a broadcast; there are fewer such groups than this.
HEAVY = 2_000


def attached(rows: DataFrame, groups: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """`rows` with the columns of the one row of `groups` that has the same `key`, null and null alike; `groups` has every key of `rows`, `size` is how many of the `total` rows have it.

    Rows of groups that hold more than one row in 2,000 do not move: fewer than 2,000 groups can be that large, so these are broadcast
    whatever the data. All others meet by a join on the key, of which no key has more rows than that.
    """
    other = "_other_key"
    heavy = groups.where(size * HEAVY > total).withColumnRenamed(key, other)
    light = groups.where(size * HEAVY <= total).withColumnRenamed(key, other)
    same = F.col(key).eqNullSafe(F.col(other))
    left = rows.join(F.broadcast(heavy.select(other)), same, "left_anti")
    return rows.join(F.broadcast(heavy), same).unionByName(left.join(light, same)).drop(other)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, null as None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches, rows: int = 512):
    """The record batches of `batches`, cut to at most `rows` rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a worker remembers from task to task, by the work that it is for; forgotten once the worker is given other work.
REMEMBERED: dict[str, dict] = {}


def remembered(work: str) -> dict:
    """What this worker remembers for tasks of `work`. What it remembers for others is dropped, since workers live on beside those of later stages."""
    for other in REMEMBERED.keys() - {work}:
        del REMEMBERED[other]
    return REMEMBERED.setdefault(work, {})


def released(function, *clear):
    """`function` for mapInArrow, after whose task `clear` are called and freed memory goes back to the system: Python workers live on, beside those of later stages.

    What the worker remembers for other work than the function's, which is named by its module and name, is forgotten first.
    While it runs, cycles are collected seldom: millions of short strings make none, and each collection would walk them.
    """

    def run(batches):
        remembered(f"{getattr(function, '__module__', '')}.{getattr(function, '__name__', '')}")
        usual = gc.get_threshold()
        gc.set_threshold(100_000, 20, 100)
        try:
            yield from function(batches)
        finally:
            gc.set_threshold(*usual)
            for c in clear:
                c()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run
