"""Signals: price factors, rating revisions, composites, decay, and adaptive weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import complete, ratio, rounded, row_mean
from ..sources.shared import dealt
from .cross_section import pct_rank, winsorised_rank, zscore
from .stats import rank_ic
from .time_series import lagged_return, pct_change, rolling_vol, shift


def price_factors(panel: DataFrame, price: str = "price") -> DataFrame:
    """mom_12_1, mom_6_1, mom_3_1, vol_12m and st_rev by row of a symbol's months."""
    s = ["symbol"]
    out = panel.withColumn("ret_1m", pct_change(price, s))
    out = out.withColumns({f"mom_{far}_1": lagged_return(price, 1, far, s) for far in (12, 6, 3)})
    return out.withColumn("vol_12m", rolling_vol("ret_1m", s)).withColumn("st_rev", -F.col("ret_1m"))


def revisions(actions: DataFrame, grid: DataFrame, spans: dict[str, int], breadth_days: int) -> DataFrame:
    """For every symbol and grid date d: upgrades less downgrades in (d - span, d] for each span, and breadth = (up -
    down) / (up + down) over breadth_days. Null before the symbol's first action of any kind.

    A span's count is a difference of two running sums, up to d and up to d - span, which windows from the beginning give
    in one pass; so an event is one row however many dates it reaches, and the plan holds a row for each day with events
    and each grid date of a symbol. The grid has a row a period."""
    day = F.datediff("date", F.lit("1970-01-01"))
    signed = F.when(F.col("action") == "upgrade", 1).when(F.col("action") == "downgrade", -1).otherwise(0)
    events = actions.where(F.col("date").isNotNull()).groupBy("symbol", "date").agg(F.sum(signed).alias("__net"), F.sum(F.abs(signed)).alias("__all"))
    empty = F.lit(None).cast("long")
    dates = events.select("symbol").distinct().crossJoin(F.broadcast(grid.select("date").distinct())).select("symbol", "date", empty.alias("__net"), empty.alias("__all"), F.lit(True).alias("__grid"))
    rows = events.withColumn("__grid", F.lit(False)).unionByName(dates).withColumn("__day", day)
    to = lambda end: Window.partitionBy("symbol").orderBy("__day").rangeBetween(Window.unboundedPreceding, end)
    within = lambda c, n: F.coalesce(F.sum(c).over(to(0)), F.lit(0)) - F.coalesce(F.sum(c).over(to(-n)), F.lit(0))
    found = rows.withColumns(
        {name: within("__net", n) for name, n in spans.items()}
        | {"__wide": within("__net", breadth_days), "__both": within("__all", breadth_days), "__seen": F.max(~F.col("__grid")).over(to(0))}
    ).where("__grid")
    seen = F.col("__seen")
    return found.select("symbol", "date", *(F.when(seen, F.col(n)).alias(n) for n in spans), F.when(seen, ratio("__wide", "__both")).alias("breadth"))


def family_values(panel: DataFrame, groups: dict[str, list[str]], keys: list[str], carry: list[str]) -> DataFrame:
    """(keys, symbol, family, __v): a name's carried columns and its values of a family as one array, a row a family."""
    values = lambda cs: (F.col(c).cast("double") for c in (*carry, *cs))
    parts = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*values(cs)).alias("__v")) for f, cs in groups.items()))
    return panel.select(*keys, "symbol", F.inline(parts))


def score_names(families: dict[str, list[str]], alone: dict[str, tuple[str, bool]]) -> dict[str, list[str | None]]:
    """The scores of each family: its own name, then its components' `<component>_rk`. A component of several families is
    given once, with the first."""
    groups = families | {k: [c] for k, (c, _) in alone.items()}
    first = {c: f for f, cs in reversed(groups.items()) for c in cs}
    return {f: [f, *(f"{c}_rk" if first[c] == f else None for c in cs)] for f, cs in groups.items()}


def _family_ranks(panel: DataFrame, groups: dict[str, list[str]], keys: list[str], carry: list[str]) -> DataFrame:
    """(keys, symbol, family, carry, r0 .., mean_rank): the winsorised ranks of each family's components and their mean over
    those present. A name's values of a family travel as one array to the family's cross-section, in one exchange: ranks,
    means and ranks of means are all computed where it has come to, and since no reader narrows an array, several readers
    share that exchange."""
    width = max(map(len, groups.values()))
    rows = family_values(panel, groups, keys, carry).repartition(*keys, "family")
    rows = rows.select(*keys, "symbol", "family", *(F.get("__v", F.lit(i)).alias(c) for i, c in enumerate(carry)), F.posexplode(F.slice("__v", len(carry) + 1, width)).alias("__at", "__x"))
    rows = winsorised_rank(rows, "__x", [*keys, "family", "__at"], "__r")
    one = lambda i: F.max(F.when(F.col("__at") == i, F.col("__r"))).alias(f"__r{i}")
    ranks = rows.groupBy(*keys, "family", "symbol").agg(*(F.max(c).alias(c) for c in carry), *map(one, range(width)))
    return ranks.withColumn("mean_rank", rounded(row_mean(*(f"__r{i}" for i in range(width))), 10))


def family_composites(panel: DataFrame, families: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Long (keys, symbol, family, score): components are winsorised and ranked, averaged over those present, and the
    average ranked again."""
    scores = _family_ranks(panel, families, keys, []).select(*keys, "symbol", "family", "mean_rank")
    return scores.withColumn("score", pct_rank("mean_rank", [*keys, "family"]))


def factor_scores(panel: DataFrame, families: dict[str, list[str]], alone: dict[str, tuple[str, bool]], keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Long (keys, symbol, family, carry, name, value): every component's winsorised rank as `<component>_rk`, every family's
    composite under its name (as family_composites has it), and each name in alone -> (component, again): the component's
    rank, ranked once more if again. carry: numeric columns of the panel to bring along. The rows lie together by keys and
    family; a component of several families is given once, with the first."""
    groups, named = families | {k: [c] for k, (c, _) in alone.items()}, score_names(families, alone)
    ranks = _family_ranks(panel, groups, keys, carry or [])
    once = [k for k, (_, again) in alone.items() if not again]
    ranks = ranks.withColumn("__whole", F.when(F.col("family").isin(once), F.col("mean_rank")).otherwise(pct_rank("mean_rank", [*keys, "family"])))
    cell = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    cells = [F.when(F.col("family") == f, F.array(cell(f, "__whole"), *(cell(x, f"__r{i}") for i, x in enumerate(own[1:]) if x))) for f, own in named.items()]
    return ranks.select(*keys, "symbol", "family", *(carry or []), F.inline(F.coalesce(*cells)))


def z_composite(panel: DataFrame, columns: list[str], keys: list[str], out: str = "score", digits: int = 8) -> DataFrame:
    """panel with the mean of the columns' z-scores (ddof 1) over those present, rounded so that ties are ties."""
    z = {f"__z_{c}": zscore(c, keys, 1) for c in columns}
    return panel.withColumns(z).withColumn(out, rounded(row_mean(*z), digits)).drop(*z)


def ic_decay(panel: DataFrame, score: str, ret: str, lags: int, min_names: int = 20) -> DataFrame:
    """Mean and t of the monthly IC of score with the one-month return `lag - 1` rows later, for lag 1 .. lags: all lags
    in one plan. Only complete pairs are dealt out, by lag and date, so that a task holds a few cross-sections of one lag;
    names are dealt out too, since each of their rows becomes as many as there are lags."""
    from .stats import series_stats

    panel = dealt(panel.select("date", "symbol", score, ret), "symbol")
    wide = panel.select("date", score, *(shift(ret, 1 - k, ["symbol"]).alias(f"__{k}") for k in range(1, lags + 1)))
    later = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"__{k}").alias("r")) for k in range(1, lags + 1)))
    long = wide.select("date", score, F.explode(later).alias("e")).select("date", score, "e.lag", "e.r")
    long = dealt(long.where(complete(score, "r")), "lag", "date")
    return series_stats(rank_ic(long, score, "r", ["lag", "date"], min_names), "ic", ["lag"])


def compounded_forward(panel: DataFrame, ret: str, h: int) -> DataFrame:
    """panel with ret_h, the product of the next h one-month returns less one; null if any is missing."""
    out = F.lit(1.0)
    for k in range(h):
        out = out * (1 + shift(ret, -k, ["symbol"]))
    return panel.withColumn(f"ret_{h}", out - 1)


def trailing_ic(ics: DataFrame, anchors: DataFrame, factors: list[str], months: int = 36, embargo: int = 1, least: int = 24) -> DataFrame:
    """For each factor and anchor date t: mean, std and count of the ICs dated in [t - embargo - months, t - embargo), for
    the anchors at which every factor has `least` of them. Factors are few and monthly series short, so the range join is
    on aggregates only."""
    a = anchors.select(F.col("date").alias("anchor")).withColumn("stop", F.add_months("anchor", -embargo)).withColumn("start", F.add_months("anchor", -embargo - months))
    rows = F.broadcast(a).join(ics.where(F.col("factor").isin(factors)), (F.col("date") >= F.col("start")) & (F.col("date") < F.col("stop")))
    out = rows.groupBy("factor", "anchor").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"))
    all_ = Window.partitionBy("anchor")  # a row a factor
    whole = out.withColumn("__least", F.min("n").over(all_)).withColumn("__factors", F.count("*").over(all_))
    return whole.where((F.col("__least") >= least) & (F.col("__factors") == len(factors))).drop("__least", "__factors")


def scheme_weights(stats: DataFrame, anchors: DataFrame, factors: list[str], shrink: float = 0.5) -> DataFrame:
    """Long (scheme, anchor, factor, weight, has_history) for ew, ic, ic_ir and t2 at every anchor: raw weights floored at
    zero and normalised; all nonpositive gives equal weights; ic_ir and t2 are shrunk half way to equal. Anchors that stats
    (of `trailing_ic`) leaves out have equal weights in every scheme."""
    grid = anchors.select(F.col("date").alias("anchor"), F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    stats = grid.join(stats, ["anchor", "factor"], "left").withColumn("has_history", F.col("n").isNotNull())
    ir = ratio("mean", "std")
    t = ir * F.sqrt("n")
    raw = F.array(
        F.struct(F.lit("ew").alias("scheme"), F.lit(1.0).alias("raw"), F.lit(0.0).alias("s")),
        F.struct(F.lit("ic").alias("scheme"), F.greatest("mean", F.lit(0.0)).alias("raw"), F.lit(0.0).alias("s")),
        F.struct(F.lit("ic_ir").alias("scheme"), F.greatest(ir, F.lit(0.0)).alias("raw"), F.lit(shrink).alias("s")),
        F.struct(F.lit("t2").alias("scheme"), F.when(t > 0, t * t).otherwise(0.0).alias("raw"), F.lit(shrink).alias("s")),
    )
    rows = stats.select("anchor", "factor", "has_history", F.explode(raw).alias("e")).select("anchor", "factor", "has_history", "e.*").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    w = Window.partitionBy("scheme", "anchor")
    equal = ratio(F.lit(1.0), F.count("*").over(w))
    own = F.coalesce(ratio("raw", F.sum("raw").over(w)), equal)
    return rows.withColumn("weight", F.col("s") * equal + (1 - F.col("s")) * own).select("scheme", "anchor", "factor", "weight", "has_history")


def weighted_composite(z: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(scheme, date, symbol, score) of long z (date, symbol, factor, z): an anchor's weights hold until the next anchor
    (blocks: date, anchor), renormalised over the factors that a symbol has."""
    held = blocks.select("date", "anchor").join(weights, "anchor").select("scheme", "date", "factor", "weight")
    rows = z.join(held, ["date", "factor"])
    present = F.col("z").isNotNull()
    return rows.groupBy("scheme", "date", "symbol").agg(ratio(F.sum(F.col("z") * F.col("weight")), F.sum(F.when(present, F.col("weight")))).alias("score"))


def rebalance_blocks(dates: DataFrame, every: int = 3) -> DataFrame:
    """(date, block, anchor): every k-th date is an anchor that holds until the next."""
    k = F.dense_rank().over(Window.orderBy("date"))  # one row a date
    rows = dates.select("date").distinct().withColumn("block", F.floor((k - 1) / every).cast("int"))
    return rows.withColumn("anchor", F.min("date").over(Window.partitionBy("block")))
