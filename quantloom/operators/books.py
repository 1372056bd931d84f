"""Portfolio books in long form: (date, symbol, w) weights, traded notional and returns by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clip, complete, ratio
from ..sources.shared import dealt, staged
from .cross_section import bucket
from .time_series import rolling_beta, shift


def bucketed(panel: DataFrame, score: str, ret: str, cap: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Complete rows with their bucket (n - 1 = highest score)."""
    return panel.where(complete(score, ret, cap)).withColumn("bucket", bucket(score, keys or ["date"], "symbol", n)).where(F.col("bucket").isNotNull())


def weights(rows: DataFrame, keys: list[str], cap: str | None = None) -> DataFrame:
    """rows with w: equal, or in proportion to cap, within keys."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("w", ratio(cap, F.sum(cap).over(w)) if cap else ratio(F.lit(1.0), F.count("*").over(w)))


def traded(held: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, date, traded): sum of |w - w at the previous holding date|; the first date trades sum of |w|. Dates are
    numbered by holding date. A name's rows give its changes, and the sale at the next date after its last, by lag and
    lead along the name: one shuffle by name, no self-join and no pivot. The numbers, a row a date, are broadcast."""
    keys = keys or []
    dates = held.select(*keys, "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    rows = held.join(F.broadcast(dates), [*keys, "date"]).select(*keys, "symbol", "k", "w")
    own = Window.partitionBy(*keys, "symbol").orderBy("k")
    rows = rows.withColumns({"k0": F.lag("k").over(own), "w0": F.lag("w").over(own), "k1": F.lead("k").over(own)})
    change = F.struct(F.col("k"), F.abs(F.col("w") - F.when(F.col("k0") == F.col("k") - 1, F.col("w0")).otherwise(0.0)).alias("m"))
    sale = F.when(F.coalesce(F.col("k1") != F.col("k") + 1, F.lit(True)), F.struct((F.col("k") + 1).alias("k"), F.abs("w").alias("m")))
    moves = rows.select(*keys, F.explode(F.array_compact(F.array(change, sale))).alias("e")).groupBy(*keys, F.col("e.k").alias("k")).agg(F.sum("e.m").alias("traded"))
    return dates.join(moves, [*keys, "k"]).select(*keys, "date", "traded")


def long_book(panel: DataFrame, score: str, ret: str, cap: str, n: int, cap_weighted: bool, which: int | None = None) -> DataFrame:
    """(date, gross, traded, names) of the bucket `which` (the top one by default)."""
    rows = bucketed(panel, score, ret, cap, n).where(F.col("bucket") == (n - 1 if which is None else which))
    held = weights(rows, ["date"], cap if cap_weighted else None)
    gross = held.groupBy("date").agg(F.sum(F.col("w") * F.col(ret)).alias("gross"), F.count("*").alias("names"))
    return gross.join(traded(held), "date")


def long_short(panel: DataFrame, score: str, ret: str, cap: str, n: int, cap_weighted: bool) -> DataFrame:
    """(date, long_leg, short_leg, gross, top_traded, bot_traded, traded): top bucket less bottom bucket."""
    rows = bucketed(panel, score, ret, cap, n).where(F.col("bucket").isin(0, n - 1)).withColumn("side", F.when(F.col("bucket") == 0, "bot").otherwise("top"))
    held = weights(rows, ["date", "side"], cap if cap_weighted else None)
    legs = held.groupBy("side", "date").agg(F.sum(F.col("w") * F.col(ret)).alias("leg")).join(traded(held, ["side"]), ["side", "date"])
    one = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    out = legs.groupBy("date").agg(one("leg", "top").alias("long_leg"), one("leg", "bot").alias("short_leg"), one("traded", "top").alias("top_traded"), one("traded", "bot").alias("bot_traded"))
    return out.withColumn("gross", F.col("long_leg") - F.col("short_leg")).withColumn("traded", F.coalesce("top_traded", F.lit(0.0)) + F.coalesce("bot_traded", F.lit(0.0)))


def book_series(panel: DataFrame, score: str, ret: str, cap: str, legs: list[tuple[str, str, int, int, bool]]) -> DataFrame:
    """(series, date, gross, traded) of several books in one plan. legs: (series, side, n, bucket, cap_weighted), side
    'top' held long or 'bot' short. Names are ranked once a date for all n, and each goes, with its raw weight, to the
    legs whose bucket it is in; weights, returns and traded notional are then of (series, side, date). A series with a
    short leg has no gross where one of its legs is empty."""
    rows = panel.where(complete(score, ret, cap))
    rows = rows.withColumns({f"__b{n}": bucket(score, ["date"], "symbol", n) for n in sorted({leg[2] for leg in legs})})
    raw = {True: F.col(cap).cast("double"), False: F.lit(1.0)}
    into = [F.when(F.col(f"__b{n}") == b, F.struct(F.lit(k).alias("series"), F.lit(side).alias("side"), raw[weighted].alias("raw"))) for k, side, n, b, weighted in legs]
    rows = rows.select("date", "symbol", F.col(ret).alias("ret"), F.explode(F.array_compact(F.array(*into))).alias("e"))
    held = weights(rows.select("date", "symbol", "ret", "e.*"), ["series", "side", "date"], "raw")
    ends = held.groupBy("series", "side", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("leg"))
    ends = ends.join(traded(held, ["series", "side"]), ["series", "side", "date"])
    top, bot = F.max(F.when(F.col("side") == "top", F.col("leg"))), F.max(F.when(F.col("side") == "bot", F.col("leg")))
    two_legged = F.col("series").isin([k for k, side, *_ in legs if side == "bot"])
    out = ends.groupBy("series", "date").agg(top.alias("__top"), bot.alias("__bot"), F.sum("traded").alias("traded"))
    return out.select("series", "date", F.when(two_legged, F.col("__top") - F.col("__bot")).otherwise(F.col("__top")).alias("gross"), "traded")


def beta_neutral(legs: DataFrame, market: DataFrame, months: int = 36, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Short leg scaled by last month's ratio of the legs' rolling betas, held to bounds; no gross before there is one."""
    rows = legs.join(market.select("date", F.col("ret").alias("mkt")), "date").withColumn("__s", F.lit(1))
    rows = rows.withColumn("b_long", rolling_beta("long_leg", "mkt", ["__s"], months)).withColumn("b_short", rolling_beta("short_leg", "mkt", ["__s"], months))
    rows = rows.withColumn("__raw", clip(ratio("b_long", "b_short"), low, high)).withColumn("scale", shift("__raw", 1, ["__s"]))
    rows = rows.withColumn("gross", F.col("long_leg") - F.col("scale") * F.col("short_leg"))
    return rows.withColumn("traded", F.col("top_traded") + F.col("bot_traded") * F.abs(F.coalesce("scale", F.lit(1.0)))).select("date", "scale", "gross", "traded")


def sector_neutral(panel: DataFrame, score: str, ret: str, cap: str, sector: str, n: int) -> DataFrame:
    """(date, gross, traded, n_sec): top less bottom bucket within each sector of at least n names, equal over sectors;
    stock weights are +-w / sectors; traded is the absolute change of all of them, on which costs are charged (each leg's
    share of it is taken as a half)."""
    rows = bucketed(panel.where(F.col(sector).isNotNull()), score, ret, cap, n, ["date", sector]).where(F.col("bucket").isin(0, n - 1))
    rows = rows.withColumn("side", F.when(F.col("bucket") == 0, "bot").otherwise("top"))
    held = weights(rows, ["date", sector, "side"])
    n_sec = F.size(F.collect_set(sector).over(Window.partitionBy("date")))
    held = held.withColumn("n_sec", n_sec).withColumn("w", ratio("w", "n_sec"))
    sign = F.when(F.col("side") == "top", F.col("w")).otherwise(-F.col("w"))
    gross = held.groupBy("date").agg(F.sum(sign * F.col(ret)).alias("gross"), F.max("n_sec").alias("n_sec"))
    moves = traded(held, ["side"]).groupBy("date").agg(F.sum("traded").alias("traded"))
    return gross.join(moves, "date")


def universe_return(panel: DataFrame, ret: str, cap: str | None = None) -> DataFrame:
    """(date, ret) of all names, equal or cap weighted."""
    rows = panel.where(complete(ret, *([cap] if cap else [])))
    mean = ratio(F.sum(F.col(ret) * F.col(cap)), F.sum(cap)) if cap else F.avg(ret)
    return rows.groupBy("date").agg(mean.alias("ret"))


def fractiles(panel: DataFrame, score: str, ret: str, cap: str, n: int, cap_weighted: bool) -> DataFrame:
    """(date, fractile, ret, names): fractile 1 holds the highest scores."""
    rows = bucketed(panel, score, ret, cap, n).withColumn("fractile", F.lit(n) - F.col("bucket"))
    mean = ratio(F.sum(F.col(ret) * F.col(cap)), F.sum(cap)) if cap_weighted else F.avg(ret)
    return rows.groupBy("date", "fractile").agg(mean.alias("ret"), F.count("*").alias("names"))


def name_turnover(panel: DataFrame, score: str, ret: str, cap: str, n: int) -> DataFrame:
    """(fractile, turnover): mean over dates, the first left out, of half the equal weights' absolute change."""
    rows = bucketed(panel, score, ret, cap, n).withColumn("fractile", F.lit(n) - F.col("bucket"))
    moves = traded(weights(rows, ["fractile", "date"]), ["fractile"])
    later = moves.withColumn("k", F.row_number().over(Window.partitionBy("fractile").orderBy("date"))).where("k > 1")
    return later.groupBy("fractile").agg((F.avg("traded") / 2).alias("turnover"))


def active_stats(per_year: int = 12) -> list[Column]:
    """act_*, te_*, ir_* and succ_* of monthly `top`, `bot` (less all names) and `ls`."""
    year, root = F.lit(float(per_year)), F.sqrt(F.lit(float(per_year)))
    aggs = [(F.avg(k) * year).alias(f"act_{k}") for k in ("top", "bot", "ls")] + [(F.stddev_samp(k) * root).alias(f"te_{k}") for k in ("top", "bot")]
    return aggs + [(ratio(F.avg(k), F.stddev_samp(k)) * root).alias(f"ir_{k}") for k in ("top", "bot")] + [F.avg(F.when(F.col(k) > 0, 1.0).when(F.col(k).isNotNull(), 0.0)).alias(f"succ_{k}") for k in ("top", "bot")]


def fractile_screen(long: DataFrame, score: str, ret: str, keys: list[str], n: int = 10, per_year: int = 12) -> DataFrame:
    """(keys, act_top, act_bot, act_ls, te_top, te_bot, ir_top, ir_bot, succ_top, succ_bot, turn_top, turn_bot): the outer
    fractiles against all names, by key. A book of a factor and side is one series of weights in one plan. The names of the
    outer fractiles, with the mean of all, are staged, so that the rows are ranked once for returns and turnover."""
    all_ = F.avg(ret).over(Window.partitionBy(*keys, "date"))
    rows = long.where(complete(score, ret)).withColumn("__b", bucket(score, [*keys, "date"], "symbol", n)).withColumn("__all", all_)
    side = F.when(F.col("__b") == 0, "bot").otherwise("top").alias("side")
    outer = staged(rows.where(F.col("__b").isin(0, n - 1)).select(*keys, "date", "symbol", side, F.col(ret).alias("__ret"), "__all"), "outer-fractiles")
    end = lambda k: F.avg(F.when(F.col("side") == k, F.col("__ret")))
    legs = outer.groupBy(*keys, "date").agg(F.max("__all").alias("__all"), end("top").alias("__top"), end("bot").alias("__bot"))
    legs = legs.select(*keys, *((F.col(f"__{k}") - F.col("__all")).alias(k) for k in ("top", "bot")), (F.col("__top") - F.col("__bot")).alias("ls"))
    own = [*keys, "side"]
    moves = traded(weights(outer.select(*own, "date", "symbol"), [*own, "date"]), own).withColumn("__k", F.row_number().over(Window.partitionBy(*own).orderBy("date"))).where("__k > 1")
    turn = moves.groupBy(*keys).agg(*((F.avg(F.when(F.col("side") == k, F.col("traded"))) / 2).alias(f"turn_{k}") for k in ("top", "bot")))
    return legs.groupBy(*keys).agg(*active_stats(per_year)).join(turn, keys, "left")


def fractile_report(panel: DataFrame, score: str, ret: str, cap: str, n: int, cap_weighted: bool, keys: list[str], per_year: int = 12) -> DataFrame:
    """(keys, row, n, total, active, te, ir, t, success, vol, sharpe, beta, alpha, turnover) for the fractiles (Q or D, 1
    the highest scores), the spread of first and last, and the market of all names. Fractiles are held against the
    market, spread and market stand for themselves; beta is sample covariance over population variance."""
    rows = bucketed(panel, score, ret, cap, n, [*keys, "date"]).withColumn("fractile", F.lit(n) - F.col("bucket"))
    top, bottom = (F.sum(F.col(ret) * F.col(cap)), F.sum(cap)) if cap_weighted else (F.sum(ret), F.count("*"))
    sums = rows.groupBy(*keys, "date", "fractile").agg(top.alias("__s"), bottom.alias("__c"), F.count("*").alias("__n"))
    prefix, null = "Q" if n == 5 else "D", F.lit(None).cast("double")
    # A row a date: the market and all fractiles. What is reported follows from it without a join or a union.
    of = lambda k: F.max(F.when(F.col("fractile") == k, ratio("__s", "__c")))
    days = sums.groupBy(*keys, "date").agg(ratio(F.sum("__s"), F.sum("__c")).alias("m"), *(of(k).alias(f"__r{k}") for k in range(1, n + 1)))
    cell = lambda row, r, m, a: F.struct(F.lit(row).alias("row"), r.alias("r"), m.alias("m"), a.alias("a"))
    m, each, spread = F.col("m"), [(k, F.col(f"__r{k}")) for k in range(1, n + 1)], F.col("__r1") - F.col(f"__r{n}")
    cells = F.array(*(cell(f"{prefix}{k}", r, m, r - m) for k, r in each), cell(f"{prefix}1-{prefix}{n}", spread, null, spread), cell("Market", m, null, m))
    long = days.select(*keys, F.inline(cells)).where(F.col("r").isNotNull())
    year, root = F.lit(float(per_year)), F.sqrt(F.lit(float(per_year)))
    grown = F.product(1 + F.col("r"))
    total = F.when(grown > 0, F.pow(grown, year / F.count("r")) - 1)
    beta = F.when(F.count("m") >= 12, ratio(F.covar_samp("r", "m"), F.var_pop("m")))
    out = long.groupBy(*keys, "row").agg(
        F.count("*").alias("n"), total.alias("total"), (F.stddev_samp("a") * root).alias("te"), (ratio(F.avg("a"), F.stddev_samp("a")) * root).alias("ir"), F.avg(F.when(F.col("a") > 0, 1.0).otherwise(0.0)).alias("success"),
        (F.stddev_samp("r") * root).alias("vol"), (ratio(F.avg("r"), F.stddev_samp("r")) * root).alias("sharpe"), beta.alias("beta"), ((F.avg("r") - beta * F.avg("m")) * per_year).alias("alpha"),
    )
    of_market = lambda c: F.max(F.when(F.col("row") == "Market", F.col(c))).over(Window.partitionBy(*keys))
    out = out.withColumns({"__market": of_market("total"), "__months": of_market("n")})  # a row a fractile
    out = out.withColumn("active", F.when(F.col("row") == "Market", 0.0).when(F.col("row").contains("-"), F.col("total")).otherwise(F.col("total") - F.col("__market")))
    out = out.withColumn("t", F.col("ir") * F.sqrt(F.col("__months") / year)).drop("__market", "__months")
    turnover = fractile_turnover(rows, sums, keys).select(*keys, F.concat(F.lit(prefix), F.col("fractile")).alias("row"), "turnover")
    return out.join(turnover, [*keys, "row"], "left")


def fractile_turnover(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fractile, turnover) of name_turnover, by counts: with equal weights a date's trades follow from the names
    held at it, at the holding date before, and at both. rows: (keys, fractile, symbol, date); sums: a row a fractile and
    date with its names `__n`. Of a name only its key, fractile and date are shuffled, once."""
    own = Window.partitionBy(*keys, "fractile", "symbol").orderBy("date")
    named = dealt(rows.select(*keys, "fractile", "symbol", "date"), *keys, "fractile", "symbol")
    stays = named.withColumn("__date0", F.lag("date").over(own)).groupBy(*keys, "fractile", "date", "__date0").agg(F.count("*").alias("__both"))
    at = Window.partitionBy(*keys, "fractile").orderBy("date")
    dates = sums.select(*keys, "fractile", "date", "__n", F.lag("date").over(at).alias("__date0"), F.lag("__n").over(at).alias("__n0")).where("__date0 is not null")
    n, n0, both = F.col("__n"), F.col("__n0"), F.coalesce("__both", F.lit(0))
    traded = both * F.abs(1 / n - 1 / n0) + (n - both) / n + (n0 - both) / n0
    return dates.join(stays, [*keys, "fractile", "date", "__date0"], "left").groupBy(*keys, "fractile").agg((F.avg(traded) / 2).alias("turnover"))
