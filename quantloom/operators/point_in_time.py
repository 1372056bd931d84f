"""Assembly of point-in-time panels: statements, prices, flags, labels, second-vendor checks and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .asof import asof_grid, asof_join
from .cross_section import keep_first
from .stats import safe_corr
from .time_series import balanced, forward_return, pct_change

HORIZONS = (1, 3, 6)


def combined_statements(statements: dict[str, DataFrame], fields: dict[str, list[str]], keys: list[str], accepted: str) -> DataFrame:
    """One row for each key: availability is the latest acceptance over all statements, fields come from the first row
    (by acceptance, then values) of each statement."""
    stamps = reduce(DataFrame.unionByName, (s.select(*keys, accepted) for s in statements.values()))
    out = stamps.groupBy(*keys).agg(F.max(accepted).alias(accepted))
    for name, s in statements.items():
        first = keep_first(s.select(*keys, accepted, *fields[name]), keys, F.col(accepted).asc_nulls_last(), *fields[name])
        out = out.join(first.drop(accepted), keys, "left")
    return out


def consolidated(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """One row for each key with the first non-null of each value in the given order."""
    by = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(v, F.when(F.col(v).isNotNull(), by)).alias(v) for v in values))


def month_end_prices(prices: DataFrame, grid: DataFrame, within_days: int = 7) -> DataFrame:
    """Price of every symbol at every grid date: the newest positive price at most `within_days` old, else null."""
    clean = prices.where(F.col("price") > 0).select("symbol", F.col("date").alias("px_date"), "price")
    return asof_grid(clean, ["symbol"], grid, "date", "px_date", ["price"], within_days=within_days)


def with_forward_returns(panel: DataFrame, value: str = "price", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Forward returns by row of a panel (balanced: calendar months)."""
    return panel.withColumns({f"ret_fwd_{h}": forward_return(value, h, ["symbol"]) for h in horizons})


def investable_flags(panel: DataFrame, price: str, accepted: str, date: str = "date", fresh_days: int = 400) -> DataFrame:
    """has_price, has_fundamentals, lag in days, fresh_filing and investable; nulls count as false."""
    lag = F.datediff(F.col(date), F.col(accepted))
    return panel.withColumns({"has_price": F.col(price).isNotNull(), "has_fundamentals": F.col(accepted).isNotNull(), "filing_lag_days": lag}).withColumn(
        "fresh_filing", F.coalesce(F.col("filing_lag_days") <= fresh_days, F.lit(False))
    ).withColumn("investable", F.col("has_price") & F.col("has_fundamentals") & F.col("fresh_filing"))


def vendor_observations(a: DataFrame, b: DataFrame, price_a: str, price_b: str) -> DataFrame:
    """Returns of two vendors by symbol and month, and their absolute difference."""
    both = a.select("symbol", "date", price_a).join(b.select("symbol", "date", price_b), ["symbol", "date"])
    both = both.withColumns({"ret_a": pct_change(price_a, ["symbol"]), "ret_b": pct_change(price_b, ["symbol"])})
    return both.withColumn("abs_diff", F.abs(F.col("ret_a") - F.col("ret_b")))


def vendor_report(observations: DataFrame, min_corr: float = 0.95, max_diff: float = 0.10) -> DataFrame:
    """For each symbol: observations, median, 95 % quantile and maximum of the differences, correlation and flag."""
    rows = observations.where(F.col("abs_diff").isNotNull())
    q = lambda p: F.percentile("abs_diff", F.lit(p))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), q(0.5).alias("median_diff"), q(0.95).alias("p95_diff"), F.max("abs_diff").alias("max_diff"), safe_corr("ret_a", "ret_b").alias("corr"))
    return out.withColumn("flag", F.coalesce(F.col("corr") < min_corr, F.lit(False)) | (F.col("max_diff") > max_diff))


def cleaned(panel: DataFrame, observations: DataFrame, report: DataFrame, grid: DataFrame, corrupt: Column | None = None, suspect: float = 0.50) -> DataFrame:
    """Drop corrupt symbols, null suspect prices, and recompute labels on the balanced panel."""
    corrupt = corrupt if corrupt is not None else (F.col("corr") < 0.50) & (F.col("median_diff") > 0.05)
    bad = report.where(corrupt).select("symbol")
    odd = observations.where(F.col("abs_diff") > suspect).select("symbol", "date", F.lit(True).alias("suspect_month"))
    rows = panel.join(bad, "symbol", "left_anti").join(odd, ["symbol", "date"], "left").withColumn("suspect_month", F.coalesce("suspect_month", F.lit(False)))
    rows = rows.withColumn("price", F.when(~F.col("suspect_month"), F.col("price")))
    labels = with_forward_returns(balanced(rows.select("symbol", "date", "price"), grid)).drop("price")
    return rows.join(labels, ["symbol", "date"], "left")


def sector_lookup(df: DataFrame, profiles: DataFrame, members: DataFrame, key: str = "symbol") -> DataFrame:
    """df with sector: from profiles, else members, else Unknown. Both maps have a row a key."""
    p = profiles.select(key, F.col("sector").alias("__p"))
    m = members.select(key, F.col("sector").alias("__m"))
    return df.join(p, key, "left").join(m, key, "left").withColumn("sector", F.coalesce("__p", "__m", F.lit("Unknown"))).drop("__p", "__m")


def coverage(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Share of non-null values of each column, long."""
    wide = df.groupBy(*keys).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot(keys, columns, "column", "coverage")


def refreshed_value(panel: DataFrame, px_now: str, px_filing: str, mcap: str, yields: list[str], ev: str | None = None, ebitda: str | None = None) -> DataFrame:
    """Restate value measures at the live price: r = filing price / price now, held to 0.1 .. 10 (null: 1); yields times
    r, capitalisation divided by it, enterprise value moved by the change, size as minus its logarithm."""
    from ..functions import clip

    r = F.coalesce(clip(ratio(px_filing, px_now), 0.1, 10.0), F.lit(1.0))
    out = panel.withColumn("price_ratio", r).withColumns({y: F.col(y) * F.col("price_ratio") for y in yields}).withColumn("mcap_live", ratio(mcap, "price_ratio"))
    if ev and ebitda:
        live_ev = F.col("mcap_live") + (F.col(ev) - F.col(mcap))
        out = out.withColumn("ebitda_to_ev", ratio(ebitda, F.col(ev)) * ratio(F.col(ev), live_ev))
    return out.withColumn("size", -F.ln("mcap_live"))


def refreshed_prices(panel: DataFrame, prices: DataFrame, period_end: str, within_days: int = 7) -> DataFrame:
    """panel (symbol, date, period_end, ...) with px_now and px_filing: the newest price at most `within_days` before
    the rebalance date and before the period's end."""
    px = prices.where(F.col("price").isNotNull()).select("symbol", F.col("date").alias("__day"), "price")
    now = asof_join(panel, px, ["symbol"], "date", "__day", ["price"], within_days=within_days).drop("__day").withColumnRenamed("price", "px_now")
    ends = panel.where(F.col(period_end).isNotNull()).select("symbol", period_end).distinct()
    filed = asof_join(ends, px, ["symbol"], period_end, "__day", ["price"], within_days=within_days).drop("__day").withColumnRenamed("price", "px_filing")
    return now.join(filed, ["symbol", period_end], "left")


MAX_BROADCAST = 100_000


def _few(keys: DataFrame) -> DataFrame:
    """keys for a join: broadcast where there are at most MAX_BROADCAST of them."""
    return F.broadcast(keys) if keys.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else keys


def event_returns(events: DataFrame, prices: DataFrame, months: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """events (symbol, date, ...) with the return from the newest close on or before the date to the newest one on or
    before the date some months later. The dates of all horizons go through one as-of join, and only prices of symbols that
    have events are sent to it."""
    named = prices.join(_few(events.select(F.col("symbol").alias("__s")).distinct()), F.col("symbol") == F.col("__s"), "left_semi")
    px = named.where(F.col("price").isNotNull()).select("symbol", F.col("date").alias("__day"), "price")
    own = [c for c in events.columns if c != "symbol"]
    each = F.array(*(F.struct(F.lit(m).alias("__m"), F.add_months("date", m).alias("__then")) for m in (0, *months)))
    rows = events.select("symbol", F.struct(*own, F.uuid().alias("__id")).alias("__e")).select("symbol", "__e", F.col("__e.date").alias("date"))
    rows = rows.select("symbol", "__e", F.inline(each))
    found = asof_join(rows, px, ["symbol"], "__then", "__day", ["price"])
    at = lambda m: F.max(F.when(F.col("__m") == m, F.col("price"))).alias(f"__p{m}")
    wide = found.groupBy("symbol", F.col("__e.__id").alias("__id")).agg(F.first("__e").alias("__e"), *map(at, (0, *months)))
    return wide.select("symbol", *(F.col(f"__e.{c}").alias(c) for c in own), *((ratio(f"__p{m}", "__p0") - 1).alias(f"ret_fwd_{m}") for m in months))


def benchmark_returns(prices: DataFrame) -> DataFrame:
    """(date, ret) of a daily series (date, price): last close of each month, next / this - 1; a row a month."""
    months = prices.groupBy(F.last_day("date").alias("date")).agg(F.max_by("price", "date").alias("price"))
    return months.withColumn("__s", F.lit(1)).withColumn("ret", forward_return("price", 1, ["__s"])).select("date", "ret")


def master(grid: DataFrame, prices: DataFrame, filings: DataFrame, sectors: DataFrame, dates: DataFrame, accepted: str, fields: list[str]) -> DataFrame:
    """The master table: members' grid (symbol, date), month-end prices with forward returns, the newest accepted filing,
    sector (else Unknown) and flags."""
    px = with_forward_returns(month_end_prices(prices, dates)).drop("px_date")
    out = grid.join(px, ["symbol", "date"], "left")
    out = asof_join(out, filings, ["symbol"], "date", accepted, fields)
    out = out.join(sectors, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return investable_flags(out, "price", accepted)


def local_panel(prices: DataFrame, filings: DataFrame, caps: DataFrame, floats: DataFrame, fields: list[str], fallback_days: int = 90, stale_days: int = 540, top: int = 200, least: int = 50) -> DataFrame:
    """A local market's monthly panel: last close by month, clipped returns over observed months, the newest filing by
    acceptance (else period end + `fallback_days`) unless stale, float-adjusted capitalisation, the `top` largest names
    of a date, and only dates with `least` complete names."""
    from ..functions import clip, complete
    from .cross_section import top_n

    last = lambda df, value: df.groupBy("symbol", F.last_day("date").alias("date")).agg(F.max_by(value, "date").alias(value))
    p = last(prices, "price").withColumns({"ret_fwd_1": clip(forward_return("price", 1, ["symbol"]), -1.0, 1.0), "ret_fwd_3": clip(forward_return("price", 3, ["symbol"]), -1.0, 2.0)})
    f = filings.withColumn("pit_date", F.coalesce("accepted", F.date_add("fiscal_date", fallback_days)))
    p = asof_join(p, f, ["symbol"], "date", "pit_date", fields, tie=["fiscal_date"])
    stale = F.coalesce(F.datediff("date", "pit_date") > stale_days, F.lit(False))
    p = p.withColumns({c: F.when(~stale, F.col(c)) for c in fields})
    share = floats.select("symbol", clip(F.coalesce("ratio", F.lit(1.0)), 0.1, 1.0).alias("__share"))
    p = p.join(last(caps, "mcap"), ["symbol", "date"], "left").join(share, "symbol", "left")
    p = p.withColumn("mcap", F.col("mcap") * F.coalesce("__share", F.lit(1.0))).drop("__share").where(complete("mcap", "price"))
    p = top_n(p, "mcap", ["date"], "symbol", top).drop("rank")
    enough = p.groupBy("date").agg(F.count_if(complete("ret_fwd_1", *fields)).alias("__n")).where(F.col("__n") >= least).select("date")
    return p.join(enough, "date", "left_semi")
