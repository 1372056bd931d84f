"""Scans over groups of any size, in two levels.

A window holds a whole group in one task. Here rows are dealt out by ranges of (keys, order) instead, so that a group lies in
as many blocks as its size needs; each block is scanned alone, and what the blocks before it came to (a row a block) is
carried into it. Sums, products, maxima and "the last value so far" combine in this way, and with them ranks, quantiles,
as-of joins and drawdowns. Nothing but one row a block is ever in one task for a group.

The blocks are fixed by a checkpoint (range bounds are drawn from a sample, and a second drawing would differ), which goes to
spark.checkpoint.dir. For groups that fit a task the plain windows of the other modules are one shuffle and no write.

Rows with equal keys and order lie in one block: give an order that tells rows of a hot value apart, or count values first
as `value_ranks` does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_dir

BLOCK = "__block"


def fixed(df: DataFrame) -> DataFrame:
    """df checkpointed below spark.checkpoint.dir; a session on one machine may leave that unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def blocked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with a block number that rises with (keys, order)."""
    return fixed(df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id()))


_TOTAL = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}
_JOINED = {
    "sum": lambda here, before: F.coalesce(here + before, here, before),
    "product": lambda here, before: F.coalesce(here * before, here, before),
    "max": F.greatest,
    "min": F.least,
    "last": F.coalesce,
}


def running(df: DataFrame, keys: list[str], order: list[str], **columns: tuple[str, str]) -> DataFrame:
    """A blocked df with, for each out=(kind, column), the running sum, product, max, min or last non-null value of column
    up to and with the row, by keys in the given order. Nulls are passed over; null where there was none but nulls."""
    here = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)

    def total(kind: str, c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)) if kind == "last" else _TOTAL[kind](c)

    def over(kind: str, c: str, w) -> Column:
        return F.last(c, ignorenulls=True).over(w) if kind == "last" else _TOTAL[kind](c).over(w)

    blocks = df.groupBy(*keys, BLOCK).agg(*(total(kind, c).alias(out) for out, (kind, c) in columns.items()))
    carried = blocks.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(BLOCK).alias("__b"), *(over(kind, out, earlier).alias(f"__{out}") for out, (kind, _) in columns.items()))
    rows = df.withColumns({out: over(kind, c, here) for out, (kind, c) in columns.items()})
    same = F.col(BLOCK) == F.col("__b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = rows.join(carried, same)  # a row a block and key
    joined = {out: _JOINED[kind](F.col(out), F.col(f"__{out}")) for out, (kind, _) in columns.items()}
    return rows.withColumns(joined).drop("__b", *(f"__{c}" for c in [*keys, *columns]))


def value_ranks(df: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, value, __rows, __below): each distinct value of each key, how many rows have it and how many have a smaller one; a
    row of df counts `weight` times. Nulls have no rank."""
    count = F.sum(weight) if weight else F.count("*")
    counts = blocked(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("__rows")), keys, [value])
    return running(counts, keys, [value], __upto=("sum", "__rows")).select(*keys, value, "__rows", (F.col("__upto") - F.col("__rows")).alias("__below"))


def average_rank() -> Column:
    """The average rank of a row of value_ranks: ties share theirs."""
    return F.col("__below") + (F.col("__rows") + 1).cast("double") / F.lit(2.0)


def with_ranks(df: DataFrame, value: str, keys: list[str], rank: str, share: str) -> DataFrame:
    """df with the average rank of value within keys and that rank over the number of values; null for null."""
    ranks = value_ranks(df, value, keys)
    ranks = ranks.join(ranks.groupBy(*keys).agg(F.sum("__rows").alias("__n")), keys)
    ranks = ranks.select(*keys, value, average_rank().alias(rank), (average_rank() / F.col("__n")).alias(share))
    return df.join(ranks, [*keys, value], "left")


def quantiles(ranks: DataFrame, value: str, keys: list[str], **q: float) -> DataFrame:
    """(keys, n, and each name=q): quantiles with linear interpolation of value_ranks, the same as percentile's. Only the
    two values around each are looked at."""
    n = ranks.groupBy(*keys).agg(F.sum("__rows").alias("n"))
    rows = ranks.join(n, keys)
    aggs = []
    for name, at in q.items():
        place = (F.col("n") - 1) * F.lit(float(at))
        low, high = F.floor(place), F.ceil(place)
        held = lambda i: (F.col("__below") <= i) & (F.col("__below") + F.col("__rows") > i)
        a, b = F.max(F.when(held(low), F.col(value))), F.max(F.when(held(high), F.col(value)))
        aggs.append((a + (b - a) * F.max(place - low)).alias(name))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
