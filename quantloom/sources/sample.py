"""Panels over the driver's star-schema tables: suppliers (or parts) as symbols, shipping months as dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ratio
from ..operators.time_series import forward_return, pct_change
from .grid import month_ends
from .shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def lines(spark: SparkSession, sf_dir: str, symbol: str = "l_suppkey") -> DataFrame:
    """symbol, day, date (month-end) and integer measures: sums of them don't depend on the order of rows."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.col(symbol).alias("symbol"), day.alias("day"), F.last_day(day).alias("date"), _cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"),
        _cents("l_discount").alias("d"), _cents("l_tax").alias("x"), (F.col("l_returnflag") == "R").cast("long").alias("r"),
    )


def px_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("symbol", F.col("day").alias("date")).agg((ratio(F.sum("c"), F.sum("q")) / 100).alias("price"), F.sum("q").alias("volume"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector: the region of the supplier's nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    n = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 nations at any scale
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"))


def panel(spark: SparkSession, sf_dir: str, symbol: str = "l_suppkey") -> DataFrame:
    """symbol, date, price, mcap, f1 .. f5."""
    n = F.count("*")
    rows = lines(spark, sf_dir, symbol).groupBy("symbol", "date").agg(
        (ratio(F.sum("c"), F.sum("q")) / 100).alias("price"), (F.sum("c").cast("double") / 100).alias("mcap"), ratio(F.sum("d"), n).alias("f1"), ratio(F.sum("x"), n).alias("f2"),
        ratio(F.sum("q"), n).alias("f3"), ratio(F.sum("r"), n).alias("f5"),
    )
    return dealt(rows, "symbol").withColumn("f4", pct_change("mcap", ["symbol"]))  # many readers make several rows of one


FACTORS = ["f1", "f2", "f3", "f4", "f5"]


def labelled(spark: SparkSession, sf_dir: str, symbol: str = "l_suppkey") -> DataFrame:
    """panel with ret, the next row's return."""
    return panel(spark, sf_dir, symbol).withColumn("ret", forward_return("price", 1, ["symbol"]))


def bounds(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("first"), F.max(date).alias("last"))


def grid(df: DataFrame, months: int = 1) -> DataFrame:
    return month_ends(bounds(df), months=months)


def vendor_b(p: DataFrame) -> DataFrame:
    """A second vendor: the same prices, some symbols noisy and one month in 37 off."""
    k = F.col("symbol") + F.month("date") + F.year("date") * 12
    off = F.when(k % 37 == 0, 1.7).when((F.col("symbol") % 11 == 0) & (k % 2 == 0), 1.15).otherwise(1.0)
    return p.select("symbol", "date", (F.col("price") * off).alias("price_b"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "upgrade").when(F.col("event_type") == "error", "downgrade").otherwise("maintain")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), kind.alias("action"))


def day_grid(df: DataFrame, date: str = "date") -> DataFrame:
    b = bounds(df, date)
    return b.select(F.explode(F.sequence("first", "last")).alias("date"))


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(today, changes): signups join, errors leave; today's members are the even ids."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), F.col("user_id").cast("string").alias("u"), "event_type", "user_id")
    today = e.where("user_id % 2 = 0").select(F.col("u").alias("symbol")).distinct()
    log = e.where("event_type in ('signup', 'error')").select("date", F.when(F.col("event_type") == "signup", F.col("u")).alias("added"), F.when(F.col("event_type") == "error", F.col("u")).alias("removed"))
    return today, log


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, price): the average price of a day over all symbols."""
    return lines(spark, sf_dir).groupBy(F.col("day").alias("date")).agg((ratio(F.sum("c"), F.sum("q")) / 100).alias("price"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings: symbol, fiscal_date (quarter's end), accepted (null for every third), g1, g2."""
    end = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
    rows = lines(spark, sf_dir).groupBy("symbol", end.alias("fiscal_date")).agg(ratio(F.sum("d"), F.count("*")).alias("g1"), ratio(F.sum("x"), F.count("*")).alias("g2"))
    late = F.when((F.col("symbol") + F.month("fiscal_date") / 3) % 3 != 0, F.date_add("fiscal_date", 40))
    return rows.withColumn("accepted", late.cast("date"))


def free_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ratio: null for every fourth symbol, some outside 0.1 .. 1."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return s.withColumn("ratio", F.when(F.col("symbol") % 4 != 0, (F.col("symbol") % 13) / F.lit(10.0)))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts of fifty symbols: doc_id, symbol, date, size, words."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("doc_id") * 37 % 1800).cast("int"))
    return d.select("doc_id", (F.col("doc_id") % 50 + 1).alias("symbol"), day.alias("date"), F.col("n_chars").cast("double").alias("size"), (F.col("n_chars") % 97).cast("double").alias("tone"))
