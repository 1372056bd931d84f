"""Tables in and out: Parquet, CSV, cached JSON replies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, NaN and infinities as null; projections and filters reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*(nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def read_present(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema; those that df lacks are typed nulls."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report: one file with a header. For results of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def compute_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[DataFrame] | None = None) -> DataFrame:
    """The table at path, built and written first if no finished write is there, or if the files of inputs have changed
    since. (store.stored keeps versions apart and buckets them.)"""
    from .store import fingerprint

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = ["_SUCCESS", *([f"_made_from_{fingerprint(inputs)}"] if inputs else [])]
    where = [spark._jvm.org.apache.hadoop.fs.Path(folder, m) for m in marks]
    if not all(fs.exists(w) for w in where):
        build().write.mode("overwrite").parquet(path)
        for w in where[1:]:
            fs.create(w, True).close()
    return spark.read.parquet(path)


def bulk(parts: list[DataFrame], schema: T.StructType, dates: list[str], order: list[str]) -> DataFrame:
    """Fetched parts as one table of the schema: dates that don't parse make a row drop out; sorted within partitions by
    ranges of `order`."""
    rows = reduce(DataFrame.unionByName, (read_present(p, schema) for p in parts))
    rows = rows.withColumns({d: F.try_to_timestamp(d).cast("date") for d in dates})
    for d in dates:
        rows = rows.where(F.col(d).isNotNull())
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def cache_key(*parts: str | Column) -> Column:
    """16 hex digits of the SHA-1 of the parts (endpoint and parameters; never a secret)."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def parse_cached(df: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """The records of a JSON array in column `body`, by an explicit schema, one row each; malformed bodies give none."""
    others = [c for c in df.columns if c != body]
    return df.select(*others, F.explode(F.from_json(F.col(body), T.ArrayType(schema))).alias("__r")).select(*others, "__r.*")


def dedup_prices(df: DataFrame) -> DataFrame:
    """Pages of a paginated price series may overlap: one row for each symbol and date, the page read first."""
    from ..operators.cross_section import keep_first

    return keep_first(df, ["symbol", "date"], "page")
