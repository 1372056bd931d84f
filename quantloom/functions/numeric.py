"""Null-safe arithmetic. Everything stays inside Catalyst expressions; ANSI mode may be on or off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Half-up rounding by the IEEE expression floor(x * 10^d + 0.5) / 10^d, the same in every engine; NaN and
    infinities become null."""
    scale = F.lit(float(10**digits))
    return F.floor(nan_to_null(x) * scale + F.lit(0.5)).cast("double") / scale


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null where b is zero or either is null."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def nan_to_null(x: str | Column) -> Column:
    """NaN and infinities become null."""
    x = _col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def clip(x: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x held within bounds; null stays null (least and greatest alone would skip it)."""
    out = x = _col(x)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def row_mean(*cols: str | Column) -> Column:
    """Mean across columns, skipping nulls; null if all are."""
    cols = [_col(c) for c in cols]
    return ratio(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), sum((c.isNotNull().cast("int") for c in cols), F.lit(0)))


def row_weighted_mean(pairs: list[tuple[str | Column, str | Column | float]]) -> Column:
    """Sum of w * x over the columns that aren't null, divided by the sum of their weights."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for x, w in pairs:
        x, w = _col(x), F.lit(w) if isinstance(w, float) else _col(w)
        top, bottom = top + F.coalesce(x * w, F.lit(0.0)), bottom + F.when(x.isNotNull(), F.coalesce(w, F.lit(0.0))).otherwise(F.lit(0.0))
    return ratio(top, bottom)


def complete(*cols: str | Column) -> Column:
    """True where no column is null."""
    out = F.lit(True)
    for c in cols:
        out = out & _col(c).isNotNull()
    return out


def quoted(name: str) -> str:
    """A column's name for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"
