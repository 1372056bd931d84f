"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_BYTES, MAX_TASKS = 2 << 20, 2000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine may leave it unset and gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/quantloom-{spark.sparkContext.applicationId}"
    if "://" not in found:  # a plain path belongs to the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", found).rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's JVM ends in good order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once below the shared folder, compressed, and read back by all who need it; it lasts as long as the driver."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys, into a task for each `TASK_BYTES` of the files it is made of, so that the share of a task
    doesn't grow with the input while there are keys enough. Frames without files get the session's number of tasks."""
    size = 0
    for name in df.inputFiles():
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        size += where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return df.repartition(min(-(-size // TASK_BYTES), MAX_TASKS), *keys) if size else df.repartition(*keys)
