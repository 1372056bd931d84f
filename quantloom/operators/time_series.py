"""Time-series operators by symbol or series. Shifts are by row; frames are always spelt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import quoted, ratio
from .ranges import BLOCK, blocked, running


def by(keys: list[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(keys: list[str], n: int, order: str = "date") -> WindowSpec:
    return by(keys, order).rowsBetween(1 - n, 0)


def shift(value: str | Column, k: int, keys: list[str], order: str = "date") -> Column:
    """k rows back (k > 0) or ahead (k < 0)."""
    return (F.lag if k > 0 else F.lead)(value, abs(k)).over(by(keys, order)) if k else F.col(value)


def pct_change(value: str, keys: list[str], k: int = 1, order: str = "date") -> Column:
    return ratio(value, shift(value, k, keys, order)) - 1


def forward_return(value: str, h: int, keys: list[str], order: str = "date") -> Column:
    return ratio(shift(value, -h, keys, order), value) - 1


def lagged_return(value: str, near: int, far: int, keys: list[str], order: str = "date") -> Column:
    """Return from `far` rows back to `near` rows back."""
    return ratio(shift(value, near, keys, order), shift(value, far, keys, order)) - 1


def rolling(agg: Column, counted: str, n: int, least: int, keys: list[str], order: str = "date") -> Column:
    """An aggregate over the last n rows; null with fewer than `least` values among them."""
    w = last_rows(keys, n, order)
    return F.when(F.count(counted).over(w) >= least, agg.over(w))


def within(value: str, days: int, keys: list[str], order: str = "date") -> Column:
    """Sum over the rows of the last `days` days, a row's own among them; order is a date."""
    by_keys = ", ".join(map(quoted, keys))
    return F.expr(f"sum({quoted(value)}) over (partition by {by_keys} order by {quoted(order)} range between interval {days - 1} days preceding and current row)")


def rolling_vol(ret: str, keys: list[str], n: int = 12, least: int = 6, per_year: int = 12) -> Column:
    return rolling(F.stddev_samp(ret), ret, n, least, keys) * F.sqrt(F.lit(float(per_year)))


def rolling_mean(value: str, keys: list[str], n: int = 12, least: int = 6) -> Column:
    return rolling(F.avg(value), value, n, least, keys)


def rolling_beta(y: str, x: str, keys: list[str], n: int = 36) -> Column:
    """Covariance over variance of the last n rows; null unless all are complete."""
    w = last_rows(keys, n)
    both = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)
    return F.when(F.count(both).over(w) >= n, ratio(F.covar_samp(y, x).over(w), F.var_samp(x).over(w)))


def growth(ret: str, keys: list[str], order: str = "date") -> Column:
    """Growth of one: the running product of 1 + ret."""
    return F.product(1 + F.col(ret)).over(by(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def with_drawdown(df: DataFrame, ret: str, keys: list[str], order: str | list[str] = "date", wide: bool = False) -> DataFrame:
    """df with growth and drawdown from the highest growth so far (the first value is the first peak). wide: series may be
    of any length, and order several columns; growth is carried from block to block, and then the peak."""
    if wide:
        order = [order] if isinstance(order, str) else order
        rows = blocked(df.withColumn("__g", 1 + F.col(ret)), keys, order)
        rows = running(running(rows, keys, order, growth=("product", "__g")), keys, order, __peak=("max", "growth"))
        return rows.withColumn("drawdown", ratio("growth", "__peak") - 1).drop("__g", "__peak", BLOCK)
    df = df.withColumn("growth", growth(ret, keys, order))
    peak = F.max("growth").over(by(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", ratio("growth", peak) - 1)


def balanced(df: DataFrame, grid: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """df on every (symbol, grid date); the grid has one row a period."""
    return df.select(symbol).distinct().crossJoin(F.broadcast(grid)).join(df, [symbol, date], "left")
