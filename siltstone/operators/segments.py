"""Stored indexes that grow by segments."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.store import exists

#: Most keys that a scan names as constants; more are joined.
NAMED = 1_000


class Segments:
    """Tables below `path` whose rows come in segments, on any store that Spark writes to.

    A segment counts once its row in `about` is written, which is done last: what a broken append left is written over by the next. Rows of a key lie
    in the folder of the key's bucket, so a search lists and reads the folders of its keys alone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def segments(self) -> list:
        """Rows (segment, n, buckets) of what was appended; n counts the documents, or the units of text."""
        if not exists(self.spark, f"{self.path}/about"):
            return []
        return sorted(self.spark.read.schema("segment int, n long, buckets int").parquet(f"{self.path}/about").collect())

    def commit(self, number: int, n: int, buckets: int) -> None:
        self.spark.createDataFrame([(number, n, buckets)], "segment int, n long, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/about")

    def place(self, what: str, number: int) -> str:
        return f"{self.path}/{what}/segment={number}"

    def rows(self, what: str, schema: str, segments: list[int]) -> DataFrame:
        paths = [p for p in (self.place(what, s) for s in segments) if exists(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*paths)


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(buckets)).cast("int").alias("bucket")


def of_keys(df: DataFrame, key: str, keys: list[str] | None, buckets: int) -> DataFrame:
    """The rows of `keys`, all rows for None: their folders alone are listed, and of the files in them the row groups that hold them are read."""
    if keys is None:
        return df
    return df.where(F.col("bucket").isin(sorted({zlib.crc32(k.encode()) % buckets for k in keys})) & F.col(key).isin(keys))
