"""Tables that operators write on their way to the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where all is on one machine may it be unset; a cluster without it is an error, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
        return "/tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to, below that of this application: see remove_tables."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "table", instead: DataFrame | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation. The cut table `instead`, which no plan but `df` reads, is deleted."""
    spark, path = df.sparkSession, new_place(df.sparkSession, name)
    df.write.parquet(path)
    if instead is not None:
        remove(spark, instead.stored_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows of a task of spread_by(), about.
TASK_ROWS = 500_000


def spread_by(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of about `rows` rows, dealt by `keys` over more tasks the more rows there are, which are not put together again: what a task holds does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def drop_table(df: DataFrame) -> None:
    """Delete what cut() wrote for `df`, which no plan may read any more."""
    remove(df.sparkSession, df.stored_at)


def remove_tables(spark: SparkSession) -> None:
    """Delete all that operators wrote to the shared folder in this application; results that were not written elsewhere go, too."""
    remove(spark, f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def kept_place(spark: SparkSession, source: str, name: str) -> str:
    """The path in the shared folder of what is kept for later sessions about the files at `source`: another one once these change. It is not below that of an application."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [at] if store.getFileStatus(at).isFile() else [f.getPath() for f in store.listStatus(at)]
    marks = sorted(f"{f} {store.getFileStatus(f).getLen()} {store.getFileStatus(f).getModificationTime()}" for f in files)
    return f"{shared_dir(spark)}/siltstone/kept/{hashlib.sha256(chr(10).join(marks).encode()).hexdigest()}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete `path` with all below it, on whatever store it is; nothing if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
