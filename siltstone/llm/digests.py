"""Exact duplicates by a lasting index of text digests, in buckets sorted by digest."""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm._common import MOST_BUCKETS, attached, blobs, drop_table, new_place, pieces, placed, read, released, remove, table

#: Digests of a bucket about.
BUCKET_ROWS = 1_000_000


def digest(text: bytes | None) -> bytes:
    """SHA-256 of a text in UTF-8 after lower-casing A-Z only; null counts as empty."""
    return hashlib.sha256((text or b"").lower()).digest()


def usual_buckets(spark: SparkSession, rows: int = 0) -> int:
    """One for each million digests, but as many as a shuffle has partitions at least: a task then writes one bucket, not a file for each of many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_ROWS))


def with_digest(docs: DataFrame, text: str, name: str = "digest") -> DataFrame:
    """`docs` with the digest of each whole text as binary; a narrow pass."""
    columns = docs.columns
    schema = docs.select("*", F.lit(b"").alias(name)).schema
    kind = to_arrow_type(schema[name].dataType)

    def run(batches):
        for batch in pieces(batches):
            found = pa.array([digest(t) for t in blobs(batch.column(columns.index(text)))], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*columns, name])

    return docs.mapInArrow(released(run), schema)


class DigestIndex:
    """All distinct texts of the deliveries so far, by digest: a table in buckets by `digest`, sorted within.

    Entries are (digest, keep_id, keep_row, copies), below a folder for each delivery. Those with `first` true are
    of texts that the delivery brought first: its rows with the largest id, and how many rows it had. Those with `first` false
    count the rows that later deliveries repeated. A delivery is found new by a sort-merge anti-join: the index is read bucket by bucket and
    never moved, only the delivery's distinct digests are.

    Numbered deliveries make it safe to try again: delivery k meets those before k only and replaces what a broken try of its own left.
    `path` lies on any store that Spark writes to; the buckets' number is kept there, and a new session opens the index by its path alone.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """Opens the index at `path`, or makes one of `buckets` buckets where there is none."""
        self.spark, self.path = spark, path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
        elif buckets is None:
            raise ValueError(f"there is no index at {path}; give a number of buckets to make one")
        else:
            self.buckets = max(1, min(int(buckets), MOST_BUCKETS))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{path}/about")
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, copies BIGINT, delivery INT, first BOOLEAN) USING parquet "
            f"PARTITIONED BY (delivery, first) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/entries'"
        )
        with contextlib.suppress(Exception):  # nothing has been delivered
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def close(self) -> None:
        """The session's catalogue forgets the index; its files stay. What was read from it and has not run can run no more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *why) -> None:
        self.close()

    def deliveries(self) -> list[int]:
        """Numbers of the deliveries that are in the index."""
        return sorted({int(r[0].split("/")[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()})

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, delivery: int | None = None) -> int:
        """Appends the delivery `digests` (id long, row long, digest binary) and returns its number, by default the next.

        Copies within the delivery are counted before anything moves, so a text that a third of the rows hold is one row of
        each task. What the delivery brings first and what it repeats are written one after the other.
        """
        number = max(self.deliveries(), default=-1) + 1 if delivery is None else delivery
        groups = digests.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("copies"))
        groups = table(groups.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "copies"), "delivery")
        new = groups.repartition(self.buckets, "digest")
        before = self.entries().where(F.col("first") & (F.col("delivery") < number))
        self._put(new.hint("merge").join(before.select("digest"), "digest", "left_anti"), number, "true")
        mine = self.entries().where(F.col("first") & (F.col("delivery") == number))
        self._put(new.hint("merge").join(mine.select("digest"), "digest", "left_anti"), number, "false")
        drop_table(groups)
        return number

    def _put(self, rows: DataFrame, delivery: int, first: str) -> None:
        part, view = f"PARTITION (delivery = {int(delivery)}, first = {first})", f"rows_{uuid.uuid4().hex}"
        # what a broken try left; the table is read by `rows`, so it can be appended to but not overwritten
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {part}")
        remove(self.spark, f"{self.path}/entries/delivery={int(delivery)}/first={first}")
        rows.createTempView(view)
        try:
            self.spark.sql(f"INSERT INTO {self.name} {part} SELECT digest, keep_id, keep_row, copies FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_row, delivery of the row that stays, and group_size over all deliveries; by buckets, so nothing moves."""
        kept = [F.max(F.when(F.col("first"), F.col(c))).alias(c) for c in ("keep_id", "keep_row", "delivery")]
        return self.entries().groupBy("digest").agg(*kept, F.sum("copies").alias("group_size"))

    def new_documents(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", delivery: int | None = None) -> DataFrame:
        """Adds `docs` as a delivery and gives those of its rows that stay, with all their own columns: one of each text that no delivery before had, with the largest id.

        A null text counts as an empty one, a null id as less than any other; of rows alike in id and text one stays. An empty table adds nothing.
        Texts move once, by digest and id together, so the copies of one text do not meet in one task.
        """
        own, at, back = placed(docs)
        marked = with_digest(own, at[text.lower()])
        rows = marked.select(F.col(at[doc_id.lower()]).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), "digest")
        number = self.add(rows, delivery)
        kept = self.entries().where(F.col("first") & (F.col("delivery") == number)).select(F.col("digest").alias("_digest"), "keep_id")
        same = (F.col("digest") == F.col("_digest")) & F.col(at[doc_id.lower()]).cast("long").eqNullSafe(F.col("keep_id"))
        return marked.join(kept, same, "left_semi").dropDuplicates(["digest", at[doc_id.lower()]]).select(*back)


def duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, buckets: int | None = None, deliveries: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs`, by way of a digest index at `path` (by default a new one in the shared folder).

    Texts are equal if they are identical after lower-casing A-Z; a null text counts as empty, which is a text like any
    other. Of equal texts the row with the largest id stays; a null id is less than any other, and of rows alike in id and
    text one stays. Columns beyond the two are not read. An empty table gives no rows.

    The table is delivered in `deliveries` ranges of ids about alike, the largest first, so that the row which came first is the
    one with the largest id; each is held against the index by a sort-merge anti-join and appended. Texts are read once, for their digests. Texts that more than
    one row in 2,000 holds meet their rows by a broadcast of at most 2,000 groups, all others by a join on the digest.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    rows = table(with_digest(own, "t").select("id", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    total, borders = rows.agg(F.count("*"), F.expr(f"percentile_approx(id, array({', '.join(str(k / deliveries) for k in range(1, deliveries)) or '0.0'}), 1000)")).first()
    borders = sorted(set(borders or []), reverse=True)[: max(0, deliveries - 1)]
    with DigestIndex(spark, path or new_place(spark, "digest_index"), buckets or usual_buckets(spark, total)) as index:
        number, above = [], None
        for least in [*borders, None]:
            part = rows if above is None else rows.where(F.col("id").isNull() | (F.col("id") < above))
            part, above = part if least is None else part.where(F.col("id") >= least), least
            number.append(index.add(part))
        groups = table(index.groups(), "groups")
    mine = F.lit(number[-1])
    for k, least in reversed(list(zip(number, borders, strict=False))):
        mine = F.when(F.col("id") >= least, k).otherwise(mine)
    met = attached(rows.withColumn("own", mine), groups, "digest", groups["group_size"], total)
    out = met.select(
        F.col("id").alias(doc_id),
        "keep_id",
        "group_size",
        ((F.col("row") == F.col("keep_row")) & (F.col("own") == F.col("delivery"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return out


def without_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """The rows of `docs` that duplicates() keeps, with all their own columns: a delivery to a new index."""
    spark = docs.sparkSession
    with DigestIndex(spark, new_place(spark, "digest_index"), buckets or usual_buckets(spark)) as index:
        return table(index.new_documents(docs, doc_id=doc_id, text=text), "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLES = {"op11_exact_dedup": SQL}
