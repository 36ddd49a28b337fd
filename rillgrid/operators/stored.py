"""Tables that several steps read from one evaluation, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster without one is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='rillgrid-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """df written once and read from there; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillgrid-{uuid.uuid4().hex}-{name}"
    # no marker file: a table that isn't written whole is never read, as the write raises
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
