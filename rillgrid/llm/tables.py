"""Reading inputs and cutting lineage, alike for all operators here."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session, whose tasks run in the driver, gets a temporary one; on a
    cluster that is an error, as each executor would write to a disk of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='rillgrid-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and kept when an executor is lost.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillgrid-{uuid.uuid4().hex}-{name}"
    # no marker file: a table that isn't written whole is never read, as the write raises
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    jvm = spark.sparkContext._jvm
    jvm.System.gc()  # shuffle files of what has been written go with the driver's references to them
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The bytes of a text column, summed over all rows: files are compressed and say too little."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0)


def partitions(df: DataFrame, mb: float, size: int | None = None) -> int:
    """So many partitions that each gets about mb megabytes of df's text (or of `size` bytes), and at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(text_bytes(df) if size is None else size) // int(mb * 1e6)))


def fewer(df: DataFrame, size: int, mb: float = 32) -> DataFrame:
    """df in at most so many tasks that each gets about mb megabytes of `size` bytes, or two for each core if that is more.

    For tables that are written: small inputs then don't make a file for each of many small tasks,
    and no shuffle is added.  Large inputs keep the tasks that they have.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // int(mb * 1e6))))


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 4) -> None:
    """Rows and bytes of text in one Arrow batch; the defaults, 10,000 rows of any length, hold too much with long documents.

    Plans read it when they run, which is after the operator returned, so it stays set in the session.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        have = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if have <= 0 or have > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of docs (and `more`), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
