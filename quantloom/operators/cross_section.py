"""Cross-sectional operators: everything is a window or an aggregate over the keys (usually a date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clip, ratio


def _ordered(value: str, keys: list[str], *tie: str):
    return Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), *tie)


def _size(value: str, keys: list[str], *tie: str) -> Column:
    """Values within keys, over the window that ranks them, so that it needs no sort of its own."""
    return F.count(value).over(_ordered(value, keys, *tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def avg_rank(value: str, keys: list[str]) -> Column:
    """Rank within keys, ties at their average; null for null. One window: the first and the last place of a row's peers."""
    w = _ordered(value, keys)
    last = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.col(value).isNotNull(), (F.rank().over(w) + last).cast("double") / F.lit(2.0))


def pct_rank(value: str, keys: list[str]) -> Column:
    """Average rank divided by the number of values."""
    return ratio(avg_rank(value, keys), _size(value, keys))


def winsorised_rank(df: DataFrame, value: str, keys: list[str], out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with the pct_rank of winsorise's value as column `out`. Held values keep their order, so all comes from one sort:
    the two values around a quantile are found by their places, and what lies at or beyond a bound shares its ranks."""
    w, whole = _ordered(value, keys), Window.partitionBy(*keys)
    last = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.withColumns({"__first": F.rank().over(w), "__last": last, "__n": _size(value, keys)})
    x, first, last, n = (F.col(c) for c in (value, "__first", "__last", "__n"))
    held = lambda place: F.max(F.when(x.isNotNull() & (first <= place + 1) & (last > place), x)).over(whole)
    at = {k: (n - 1) * F.lit(float(q)) for k, q in (("lo", low), ("hi", high))}
    rows = rows.withColumns({f"__{k}{side}": held(f(p)) for k, p in at.items() for side, f in (("a", F.floor), ("b", F.ceil))})
    between = lambda k: F.when(F.col(f"__{k}a") == F.col(f"__{k}b"), F.col(f"__{k}a")).otherwise((F.ceil(at[k]) - at[k]) * F.col(f"__{k}a") + (at[k] - F.floor(at[k])) * F.col(f"__{k}b"))
    rows = rows.withColumns({"__lo": between("lo"), "__hi": between("hi")})
    lo, hi = F.col("__lo"), F.col("__hi")
    rows = rows.withColumns({"__to": F.max(F.when(x <= lo, last)).over(whole), "__from": F.min(F.when(x >= hi, first)).over(whole)})
    double = F.when(lo == hi, n + 1).when(x <= lo, F.col("__to") + 1).when(x >= hi, F.col("__from") + n).otherwise(first + last)
    rank = F.when(x.isNotNull(), double.cast("double") / F.lit(2.0))
    helpers = ["__first", "__last", "__n", "__loa", "__lob", "__hia", "__hib", "__lo", "__hi", "__to", "__from"]
    return rows.withColumn(out, ratio(rank, n)).drop(*helpers)


def first_rank(value: str, keys: list[str], tie: str, descending: bool = False) -> Column:
    """Rank within keys, ties in the order of `tie`; null for null."""
    by = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return F.when(F.col(value).isNotNull(), F.row_number().over(Window.partitionBy(*keys).orderBy(by, F.col(tie))))


def bucket(value: str, keys: list[str], tie: str, n: int) -> Column:
    """Quantile bucket 0..n-1 of the first rank r among N values: max(ceil((r - 1) n / (N - 1)) - 1, 0), in integers.
    Null for groups with fewer than n values."""
    r = first_rank(value, keys, tie).cast("long")
    size = _size(value, keys, tie)
    numerator = (r - 1) * n + (size - 1) - 1
    at = F.floor(numerator / F.greatest(size - 1, F.lit(1))) - 1
    return F.when(size >= n, F.greatest(at, F.lit(0)).cast("int"))


def winsorise(df: DataFrame, value: str, keys: list[str], low: float = 0.01, high: float = 0.99, out: str | None = None, wide: bool = False) -> DataFrame:
    """value held within its quantiles (linear interpolation) of each group, as column `out`. wide: groups may be of any
    size; the quantiles then come from ranges of values, not from a buffer of each group's values."""
    if wide:
        from .ranges import quantiles, value_ranks

        bounds = quantiles(value_ranks(df, value, keys), value, keys, __lo=low, __hi=high).drop("n")
        return df.join(bounds, keys, "left").withColumn(out or value, clip(value, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    bounds = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("__lo"), F.percentile(value, F.lit(high)).alias("__hi"))
    return df.join(bounds, keys).withColumn(out or value, clip(value, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def zscore(value: str, keys: list[str], ddof: int = 0) -> Column:
    """(x - mean) / std within keys; null where the spread is zero."""
    w = Window.partitionBy(*keys)
    spread = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value).over(w)
    return ratio(F.col(value) - F.avg(value).over(w), spread)


def top_n(df: DataFrame, value: str, keys: list[str], tie: str, n: int) -> DataFrame:
    """The n largest values of each group, with their rank."""
    return df.withColumn("rank", first_rank(value, keys, tie, descending=True)).where(F.col("rank") <= n)


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key: the first in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
