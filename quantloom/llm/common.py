"""Shared helpers: the cluster's shared folder, staged tables, table loading and column names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session without executors of its own (a `local`
    master, as in tests) may leave it unset; it then gets a temporary folder for the application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/quantloom-{os.getuid()}-{spark.sparkContext.applicationId}"
    if "://" not in found:  # a plain path belongs to the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        found = found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's JVM ends in good order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors don't matter. The table lasts
    as long as the driver."""
    return staged_in(df, new_folder(df.sparkSession, name))


def staged_in(df: DataFrame, path: str) -> DataFrame:
    """`staged` under a path of the caller's, who may `discard` it sooner."""
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path)
    scratch(spark, path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later table is made from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """(filesystem, path) for a URI of any scheme pyarrow opens; executors and driver use it alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def named(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, each with as many underscores added as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """df's columns as expressions, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]
