"""Results that several steps read are written once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where driver and executors are one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="skylot-"))
    return _local[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: its plan ends there and lost executors cost no earlier step. The files go when
    the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skylot-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
