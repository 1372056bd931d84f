"""As-of joins without range joins: both sides are unioned and the newest right row so far is carried along a window
by key, so the cost is one shuffle by key and one sort, whatever the number of matches. A key that holds a large share of
all rows is one task's work then; with `wide` it is spread over blocks of time instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cross_section import keep_first
from .ranges import BLOCK, blocked, running


def stream(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, take: list[str], tie: list[str] | None = None) -> DataFrame:
    """Both sides of an as-of join as one table: by, __t, __side (0 right, 1 left), __l, __r. It may be stored by key."""
    right = keep_first(right, [*by, right_on], *(F.desc(c) for c in tie)) if tie else right
    l_cols = [c for c in left.columns if c not in by]
    payload = F.struct(F.col(right_on), *(F.col(c) for c in take if c != right_on))
    l_side = left.select(*by, F.col(on).cast("timestamp").alias("__t"), F.lit(1).alias("__side"), F.struct(*l_cols).alias("__l"), F.lit(None).alias("__r"))
    r_side = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).cast("timestamp").alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), payload.alias("__r"))
    return l_side.unionByName(r_side)


def carried(rows: DataFrame, by: list[str], right_on: str, within_days: int | None = None, wide: bool = False) -> DataFrame:
    """The left rows of a stream with their right rows, right_on first."""
    l_cols, take = (rows.schema[c].dataType.names for c in ("__l", "__r"))
    if wide:
        # Left rows of one time are told apart by a hash, so that they need not lie in one block.
        rows = rows.withColumn("__salt", F.when(F.col("__side") == 1, F.xxhash64("__l")).otherwise(0))
        order = ["__t", "__side", "__salt"]
        rows = running(blocked(rows, by, order), by, order, __r=("last", "__r")).where("__side = 1")
    else:
        w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if within_days is not None:
        rows = rows.withColumn("__r", F.when(F.datediff(F.col("__t"), F.col(f"__r.{right_on}")) <= within_days, F.col("__r")))
    bring: list[Column] = [F.col(f"__r.{c}").alias(c) for c in take]
    return rows.select(*by, *(F.col(f"__l.{c}").alias(c) for c in l_cols), *bring)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, take: list[str], tie: list[str] | None = None, within_days: int | None = None, wide: bool = False) -> DataFrame:
    """Backward as-of join: each left row with the newest right row of its key at or before `on`.

    take: right columns to bring (the row is taken whole: a null in it is not filled from an older row). tie: right
    columns that order rows with equal times, the last wins. within_days: older matches count as none. `right_on` comes
    along as a column. Both times are compared as timestamps. wide: keys may have any number of rows, left and right, at one
    time too; costs a checkpoint."""
    return carried(stream(left, right, by, on, right_on, take, tie), by, right_on, within_days, wide)


def asof_grid(right: DataFrame, by: list[str], grid: DataFrame, on: str, right_on: str, take: list[str], tie: list[str] | None = None, within_days: int | None = None, wide: bool = False) -> DataFrame:
    """asof_join of every key of right at every date of a grid (one column `on`, a row a period), nulls before a key's first
    row: the grid's dates are not shuffled. A right row holds until the key's next one, so after one window over right alone
    it is given to the dates of its span. A key's first row also gives the dates before it. Rows without `right_on` count for
    the key only. wide: a key may have any number of rows; costs a checkpoint."""
    payload = F.struct(F.col(right_on), *(F.col(c) for c in take if c != right_on))
    never = F.lit("0001-01-01").cast("timestamp")  # before any date: such a row gives a key's dates no match
    rows = right.select(*by, F.coalesce(F.col(right_on).cast("timestamp"), never).alias("__t"), payload.alias("__r"), *(F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie or [])))
    ties = [f"__tie{i}" for i in range(len(tie or []))]
    if wide:
        rows = blocked(rows, by, ["__t", *ties])
        here = Window.partitionBy(*by, BLOCK).orderBy("__t", *ties)
        # The next block's first row of the key closes a block's last span, and tells whether a block is the key's first.
        ends = rows.groupBy(*by, BLOCK).agg(F.min(F.struct("__t")).alias("__least"))
        of_key = Window.partitionBy(*by).orderBy(BLOCK)
        ends = ends.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col(BLOCK).alias("__b"), F.lead("__least").over(of_key)["__t"].alias("__after"), (F.row_number().over(of_key) == 1).alias("__opens"))
        same = F.col(BLOCK) == F.col("__b")
        for i, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
        rows = rows.withColumns({"__next": F.lead("__t").over(here), "__at": F.row_number().over(here)}).join(ends, same)
        rows = rows.withColumns({"__next": F.coalesce("__next", "__after"), "__first": F.col("__opens") & (F.col("__at") == 1)})
    else:
        w = Window.partitionBy(*by).orderBy("__t", *ties)
        rows = rows.withColumns({"__next": F.lead("__t").over(w), "__first": F.row_number().over(w) == 1})
    dates = grid.agg(F.sort_array(F.collect_list(on)).alias("__dates"))  # a row a period
    time = lambda d: d.cast("timestamp")
    inside = F.filter("__dates", lambda d: (time(d) >= F.col("__t")) & (F.col("__next").isNull() | (time(d) < F.col("__next"))))
    spans = F.transform(inside, lambda d: F.struct(d.alias("d"), F.lit(True).alias("has")))
    early = F.transform(F.filter("__dates", lambda d: F.col("__first") & (time(d) < F.col("__t"))), lambda d: F.struct(d.alias("d"), F.lit(False).alias("has")))
    rows = rows.crossJoin(F.broadcast(dates)).select(*by, "__r", F.inline(F.concat(early, spans)))
    has = F.col("has") & F.col(f"__r.{right_on}").isNotNull()
    if within_days is not None:
        has &= F.datediff("d", F.col(f"__r.{right_on}")) <= within_days
    names = [right_on, *(c for c in take if c != right_on)]
    return rows.select(*by, F.col("d").alias(on), *(F.when(has, F.col(f"__r.{c}")).alias(c) for c in names))
