"""Calendar grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def month_ends(bounds: DataFrame, first: str = "first", last: str = "last", months: int = 1) -> DataFrame:
    """(date): the month-ends, every `months` months of the calendar, within [first, last] of a one-row frame."""
    start = F.trunc(first, "MM") if months == 1 else F.add_months(F.trunc(first, "quarter"), 2)
    stop = F.trunc(F.col(last), "MM")
    each = F.explode(F.when(start <= stop, F.sequence(start, stop, F.expr(f"interval {months} month"))))
    dates = bounds.select(first, last, each.alias("m")).withColumn("date", F.last_day("m"))
    return dates.where((F.col("date") >= F.col(first)) & (F.col("date") <= F.col(last))).select("date")


def quarter_ends(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    return month_ends(bounds, first, last, 3)


def between(spark: SparkSession, first: str, last: str, months: int = 1) -> DataFrame:
    return month_ends(spark.sql(f"select date'{first}' as first, date'{last}' as last"), months=months)
