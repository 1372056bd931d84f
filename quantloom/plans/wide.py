"""Queries over groups of any size (scans in blocks) and over stored tables, each with its SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import asof, cross_section, ranges, time_series
from ..sources import sample
from ..sources.shared import remove_at_end, shared_dir
from ..sources.store import stored
from .catalog import _asof_filings, _FILINGS, _more, add, out, six
from .sql import query, r6

_Q = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
_LINE = "select l_orderkey as okey, l_linenumber as line, l_returnflag as flag, l_extendedprice as price from lineitem"


def _lines(s, d):
    return sample.table(s, d, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))


@add("wide_quantiles", f"select flag, count(*) as n, {', '.join(f'{r6(f'quantile_cont(price, {q})')} as {k}' for k, q in _Q.items())} from ({_LINE}) group by flag")
def _(s, d):
    return six(ranges.quantiles(ranges.value_ranks(_lines(s, d), "price", ["flag"]), "price", ["flag"], **_Q), ["flag", "n"], *_Q)


_RANK = "rank() over (partition by flag order by price) + (count(*) over (partition by flag, price) - 1)/2.0::double"


@add("wide_ranks", f"select okey, line, flag, rk, {r6('rk/n')} as share from (select okey, line, flag, {_RANK} as rk, count(*) over (partition by flag) as n from ({_LINE}))")
def _(s, d):
    rows = ranges.with_ranks(_lines(s, d), "price", ["flag"], "rk", "share")
    return out(rows, "okey", "line", "flag", "rk", share="share")


@add("wide_winsorise", f"select okey, line, flag, {r6('least(greatest(price, lo), hi)', 4)} as price from ({_LINE}) join (select flag, quantile_cont(price, 0.01) as lo, quantile_cont(price, 0.99) as hi from ({_LINE}) group by flag) using (flag)")
def _(s, d):
    rows = cross_section.winsorise(_lines(s, d), "price", ["flag"], wide=True)
    return rows.select("okey", "line", "flag", rounded("price", 4).alias("price"))


@add("wide_asof_filings", f"with {_FILINGS} select l.symbol, l.date, f.accepted, f.cents from lefts l asof left join f on l.symbol = f.symbol and l.date >= f.accepted")
def _(s, d):
    return _asof_filings(s, d, wide=True)


_EVENTS = "select event_type as series, event_id, ts, (event_id * 7919 % 101 - 50)/19997.0::double as x from events"
_GROWTH = f"select series, event_id, ts, product(1+x) over (partition by series order by ts, event_id rows unbounded preceding) as g from ({_EVENTS})"


@add("wide_drawdown", f"select series, event_id, {r6('g')} as growth, {r6('g/max(g) over (partition by series order by ts, event_id rows unbounded preceding)-1')} as drawdown from ({_GROWTH})")
def _(s, d):
    x = (F.col("event_id") * 7919 % 101 - 50) / F.lit(19997.0)
    rows = sample.table(s, d, "events").select(F.col("event_type").alias("series"), "event_id", "ts", x.alias("x"))
    return six(time_series.with_drawdown(rows, "x", ["series"], ["ts", "event_id"], wide=True).withColumnRenamed("growth", "g"), ["series", "event_id"], "drawdown", "g").withColumnRenamed("g", "growth")


# ---- stored tables: buckets by symbol, so that plans by symbol have no exchange ----------------------------------
BUCKETS = 16


def stored_prices(s: SparkSession, d: str) -> DataFrame:
    """Daily prices, built once for the state of their input's files."""
    path = f"{shared_dir(s)}/stored-prices-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
    lines = sample.table(s, d, "lineitem")
    found = stored(s, path, lambda: sample.px_daily(s, d), [lines], ["symbol"], ["date"], BUCKETS)
    remove_at_end(s, path)
    return found


_PX_W = "window w as (partition by symbol order by date)"


def stored_returns(s: SparkSession, d: str) -> DataFrame:
    p = stored_prices(s, d)
    p = p.withColumn("ret", time_series.pct_change("price", ["symbol"])).withColumn("ret_fwd", time_series.forward_return("price", 5, ["symbol"]))
    return p.withColumn("vol", time_series.rolling_vol("ret", ["symbol"], 20, 10, 252))


@add(
    "stored_returns",
    query(
        f"select symbol, date, {r6('ret')} as ret, {r6('ret_fwd')} as ret_fwd, case when count(ret) over v >= 10 then {r6('stddev_samp(ret) over v * sqrt(252)', 4)} end as vol from "
        f"(select symbol, date, price/nullif(lag(price) over w,0)-1 as ret, lead(price, 5) over w/nullif(price,0)-1 as ret_fwd from px {_PX_W}) "
        "window v as (partition by symbol order by date rows between 19 preceding and current row)",
        "px",
    ),
)
def _(s, d):
    return stored_returns(s, d).select("symbol", "date", rounded("ret").alias("ret"), rounded("ret_fwd").alias("ret_fwd"), rounded("vol", 4).alias("vol"))


def stored_asof(s: SparkSession, d: str) -> DataFrame:
    """For every traded day the newest earlier day with a volume of at least 40. Both sides are stored as one stream."""
    lines = sample.table(s, d, "lineitem")

    def build() -> DataFrame:
        p = sample.px_daily(s, d)
        left = p.select("symbol", F.date_sub("date", 1).alias("before"), "date", "price")
        right = p.where("volume >= 40").select("symbol", F.col("date").alias("busy"), F.col("price").alias("busy_price"))
        return asof.stream(left, right, ["symbol"], "before", "busy", ["busy_price"])

    path = f"{shared_dir(s)}/stored-stream-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
    rows = stored(s, path, build, [lines], ["symbol"], ["__t", "__side"], BUCKETS)
    remove_at_end(s, path)
    return asof.carried(rows, ["symbol"], "busy")


@add(
    "stored_asof",
    query(
        f"select l.symbol, l.date, r.date as busy, {r6('l.price/nullif(r.price,0)-1')} as since from (select *, cast(date - 1 as date) as before from px) l "
        "asof left join (select * from px where volume >= 40) r on l.symbol = r.symbol and l.before >= r.date",
        "px",
    ),
)
def _(s, d):
    return stored_asof(s, d).select("symbol", "date", "busy", rounded(F.col("price") / F.nullif("busy_price", F.lit(0.0)) - 1).alias("since"))


# ---- a paged service's cache -------------------------------------------------------------------------------------
PAGE, START = 60, "1995-06-30"
_BROKEN = "cast(symbol as long) % 13 = 5 and p = 1"


def _cached_pages(s: SparkSession, d: str, columns: str) -> DataFrame:
    """Daily prices written as a service's pages, and read back by walking each symbol's cursor."""
    from ..sources import paged

    folder = f"{shared_dir(s)}/pages-{uuid.uuid4().hex}"
    bars = sample.px_daily(s, d).select(F.col("symbol").cast("string").alias("symbol"), "date", F.col("price").alias("adjClose"), F.col("volume").cast("double").alias("volume"))
    paged.write_pages(bars, f"{folder}/pages", PAGE, broken=_BROKEN)
    bars.select("symbol").distinct().coalesce(1).write.text(f"{folder}/symbols")  # a line a symbol
    listed = next(f for f in s.read.text(f"{folder}/symbols").inputFiles())
    remove_at_end(s, folder)
    return paged.read_pages(s, f"{folder}/pages", listed, columns, page=PAGE, start=START, max_calls=10_000, per_task=8)


_PAGES = (
    f"pg as (select symbol, date, price, (row_number() over (partition by symbol order by date desc)-1)//{PAGE} as p from px)",
    f"pe as (select symbol, p, min(date) as oldest, count(*) = {PAGE} as whole from pg group by all)",
    # A page is read if all before it were whole and had not come to the start.
    f"pr as (select a.symbol, a.p from pe a where not exists (select 1 from pe b where b.symbol = a.symbol and b.p < a.p and (not b.whole or b.oldest <= date '{START}')))",
    "bad as (select symbol from pr where symbol % 13 = 5 and p = 1)",
)


@add("paged_prices", _more(query(f"select cast(symbol as varchar) as symbol, date, {r6('price')} as price from pg join pr using (symbol, p) where symbol not in (select symbol from bad)", "px"), *_PAGES))
def _(s, d):
    rows = _cached_pages(s, d, "symbol string, date date, adjClose double, _failure string")
    return out(rows.where("_failure is null"), "symbol", "date", price="adjClose")


@add("paged_failures", _more(query("select cast(symbol as varchar) as symbol, 'page 2: JSONDecodeError' as failure from bad", "px"), *_PAGES))
def _(s, d):
    rows = _cached_pages(s, d, "symbol string, _failure string")
    return rows.where("_failure is not null").select("symbol", F.col("_failure").alias("failure"))
