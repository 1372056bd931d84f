"""Point-in-time membership from today's members and a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def change_events(changes: DataFrame) -> DataFrame:
    """(symbol, date, kind) of changes (date, added, removed); blank names are none. kind 0 = removed, 1 = added, so
    that of two changes on one date the removal counts as the earlier."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    both = F.array(F.struct(clean("removed").alias("symbol"), F.lit(0).alias("kind")), F.struct(clean("added").alias("symbol"), F.lit(1).alias("kind")))
    return changes.select("date", F.explode(both).alias("e")).select("e.symbol", "date", "e.kind").where(F.col("symbol").isNotNull() & F.col("date").isNotNull())


def membership_asof(today: DataFrame, changes: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, symbol): the members at each date. The earliest change after a date decides: a name that was removed then
    was a member, one that was added was not; without a later change today's membership holds. A change dated on the
    date itself is in force already. One shuffle by name."""
    events = change_events(changes)
    names = today.select("symbol").unionByName(events.select("symbol")).distinct()
    grid = names.crossJoin(F.broadcast(dates.select("date"))).select("symbol", "date", F.lit(0).alias("side"), F.lit(None).cast("int").alias("kind"))
    rows = grid.unionByName(events.select("symbol", "date", F.lit(1).alias("side"), "kind"))
    # Backwards in time the last change seen is the next one; a date sees none of its own, and of one date's the removal.
    later = Window.partitionBy("symbol").orderBy(F.desc("date"), "side", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    state = rows.withColumn("next", F.last("kind", ignorenulls=True).over(later)).where("side = 0")
    now = today.select("symbol", F.lit(True).alias("now")).distinct()
    member = F.when(F.col("next").isNotNull(), F.col("next") == 0).otherwise(F.coalesce("now", F.lit(False)))
    return state.join(now, "symbol", "left").where(member).select("date", "symbol")
