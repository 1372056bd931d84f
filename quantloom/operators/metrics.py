"""Performance of monthly series in long form, by series id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .time_series import with_drawdown


def performance(df: DataFrame, ret: str, keys: list[str], per_year: int = 12) -> DataFrame:
    """total, cagr, vol, sharpe, max_drawdown, hit and n of each series; no cagr once everything is lost."""
    rows = with_drawdown(df.where(F.col(ret).isNotNull()), ret, keys)
    out = rows.groupBy(*keys).agg(
        (F.product(1 + F.col(ret)) - 1).alias("total"), (F.stddev_samp(ret) * F.sqrt(F.lit(float(per_year)))).alias("vol"), (F.avg(ret) * per_year).alias("mean"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit"), F.count("*").alias("n"),
    )
    cagr = F.when(F.col("total") > -1, F.pow(1 + F.col("total"), F.lit(float(per_year)) / F.col("n")) - 1)
    return out.withColumn("cagr", cagr).withColumn("sharpe", ratio("mean", "vol")).drop("mean")


def net_returns(books: DataFrame, costs_bps: list[float]) -> DataFrame:
    """books (.., gross, traded) for each cost a side: net = gross - traded * cost."""
    costs = F.explode(F.array(*(F.lit(float(c)) for c in costs_bps)))
    return books.withColumn("cost_bps", costs).withColumn("net", F.col("gross") - F.col("traded") * F.col("cost_bps") / F.lit(10000.0))


def turnover(books: DataFrame, keys: list[str], per_year: int = 12) -> DataFrame:
    """One-way turnover a year, and the average traded, by series; the first month is left out."""
    from pyspark.sql.window import Window

    rows = books.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))).where("__k > 1")
    return rows.groupBy(*keys).agg((F.avg("traded") / 2 * per_year).alias("turnover_pa"), F.avg("traded").alias("avg_traded"), F.count("*").alias("months"))


def cost_table(books: DataFrame, market: DataFrame, costs_bps: list[float], keys: list[str], per_year: int = 12) -> DataFrame:
    """For each series and cost a side: cagr, vol, sharpe and max_drawdown of the net returns, one-way turnover_pa over all
    months, cost_drag a year, and alpha after costs (the gross intercept on market (date, mkt) less the drag) with beta."""
    from .stats import capm

    net = performance(net_returns(books, costs_bps), "net", [*keys, "cost_bps"], per_year)
    moved = books.groupBy(*keys).agg((F.avg("traded") / 2 * per_year).alias("turnover_pa"))
    model = capm(books.join(market, "date"), "gross", "mkt", keys, per_year=per_year).select(*keys, "beta", F.col("alpha").alias("__gross"))
    rows = net.join(moved, keys).join(model, keys, "left").withColumn("cost_drag", F.col("turnover_pa") * 2 * F.col("cost_bps") / F.lit(10000.0))
    return rows.withColumn("alpha", F.col("__gross") - F.col("cost_drag")).drop("__gross", "total", "hit")
