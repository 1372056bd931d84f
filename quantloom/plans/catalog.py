"""The queries: Spark plans built from the library's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complete, rounded
from ..operators import asof, books, cross_section, membership, metrics, ml, point_in_time, signals, stats, text, time_series
from ..sources import sample
from ..sources.io import cache_key
from .sql import FACTORS, bucket, query, r6, rank, traded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LEXICON = {"positive": ["the", "of"], "negative": ["und", "de"], "uncertain": ["la", "que"], "litigious": ["der", "die"], "constraining": ["es", "en"], "modal": ["is", "it"]}
FAMILIES = {"value": ["f1", "f2"], "quality": ["f3", "f5"], "growth": ["f4"], "risk": ["f2", "f3"]}


def add(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def out(df: DataFrame, *plain: str, **values) -> DataFrame:
    """The plain columns as they are and the others rounded to six digits."""
    return df.select(*plain, *(rounded(v).alias(k) for k, v in values.items()))


DIGITS = {"total": 2, "growth": 2, "cagr": 4}  # values that may be large keep fewer decimals


def six(df: DataFrame, plain: list[str], *cols: str) -> DataFrame:
    return df.select(*plain, *(rounded(c, DIGITS.get(c, 6)).alias(c) for c in cols))


def sixed(*cols: str) -> str:
    return ", ".join(f"{r6(c, DIGITS.get(c, 6))} as {c}" for c in cols)


def composite(spark: SparkSession, d: str) -> DataFrame:
    return signals.z_composite(sample.labelled(spark, d), FACTORS, ["date"])


def factor_long(spark: SparkSession, d: str) -> DataFrame:
    return sample.labelled(spark, d).unpivot(["date", "symbol", "ret", "mcap"], FACTORS, "factor", "value")


def monthly_ic(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_ic(factor_long(spark, d), "value", "ret", ["factor", "date"])


def series(spark: SparkSession, d: str) -> DataFrame:
    legs = [
        ("top_quintile_cw", "top", 5, 4, True),
        ("top_decile_ew", "top", 10, 9, False),
        ("ls_quintile_ew", "top", 5, 4, False),
        ("ls_quintile_ew", "bot", 5, 0, False),
    ]
    return books.book_series(composite(spark, d), "score", "ret", "mcap", legs)


COSTS = [0.0, 5.0, 10.0, 25.0, 50.0]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Monthly rank IC of the factors with parts as symbols (there are too few suppliers at the smallest size)."""
    long = sample.labelled(spark, d, "l_partkey").unpivot(["date", "symbol", "ret"], FACTORS, "factor", "value")
    return six(stats.rank_ic(long, "value", "ret", ["factor", "date"]), ["factor", "date", "n"], "ic")


# ---- grids, scans, as-of joins -----------------------------------------------------------------------------------
@add("month_end_grid", query("select date from grid", "grid"))
def _(s, d):
    return sample.grid(sample.lines(s, d))


@add("quarter_end_grid", query("select date from grid where month(date) % 3 = 0 and date <= (select max(date) from li)", "grid"))
def _(s, d):
    return sample.grid(sample.lines(s, d), 3)


@add("last_px_per_month", query(f"select symbol, last_day(date) as month, {r6('max_by(price, date)')} as price, max(date) as px_date from px group by symbol, last_day(date)", "px"))
def _(s, d):
    g = sample.px_daily(s, d).groupBy("symbol", F.last_day("date").alias("month")).agg(F.max_by("price", "date").alias("p"), F.max("date").alias("px_date"))
    return out(g, "symbol", "month", "px_date", price="p")


_FILINGS = "f as (select o_custkey as symbol, cast(o_orderdate as date) as accepted, max_by(cast(round(o_totalprice*100) as bigint), o_orderkey) as cents from orders group by 1, 2), og as (select last_day(cast(unnest(generate_series(date_trunc('month', (select min(accepted) from f)), date_trunc('month', (select max(accepted) from f)), interval 1 month)) as date)) as date), lefts as (select symbol, date from (select distinct symbol from f), og where date <= (select max(accepted) from f))"


def _filings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = sample.table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("accepted"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sample.month_ends(sample.bounds(f, "accepted")), f


def _asof_filings(s: SparkSession, d: str, wide: bool = False) -> DataFrame:
    grid, filed = _filings(s, d)
    return asof.asof_grid(filed, ["symbol"], grid, "date", "accepted", ["cents"], tie=["o_orderkey"], wide=wide)


@add("asof_filings", f"with {_FILINGS} select l.symbol, l.date, f.accepted, f.cents from lefts l asof left join f on l.symbol = f.symbol and l.date >= f.accepted")
def _(s, d):
    return _asof_filings(s, d)


@add("filing_lag_flags", f"with {_FILINGS}, j as (select l.symbol, l.date, f.accepted, f.cents from lefts l asof left join f on l.symbol = f.symbol and l.date >= f.accepted) select symbol, date, cast(date - accepted as integer) as filing_lag_days, cents is not null as has_price, accepted is not null as has_fundamentals, coalesce(date - accepted <= 400, false) as fresh_filing, cents is not null and accepted is not null and coalesce(date - accepted <= 400, false) as investable from j")
def _(s, d):
    return point_in_time.investable_flags(_asof_filings(s, d), "cents", "accepted").select("symbol", "date", "filing_lag_days", "has_price", "has_fundamentals", "fresh_filing", "investable")


@add("asof_tolerance", query(f"select b.symbol, b.date, case when b.date - x.date <= 7 then x.date end as px_date, case when b.date - x.date <= 7 then {r6('x.price')} end as price from (select s.symbol, g.date from (select distinct symbol from px) s cross join grid g) b asof left join px x on b.symbol = x.symbol and b.date >= x.date", "px", "grid"))
def _(s, d):
    m = point_in_time.month_end_prices(sample.px_daily(s, d), sample.grid(sample.lines(s, d)))
    return out(m, "symbol", "date", "px_date", price="price")


_FWD = ", ".join(f"lead(price, {h}) over w/nullif(price,0)-1 as ret_fwd_{h}" for h in (1, 3, 6))


@add("forward_returns", query(f"select symbol, date, {sixed('ret_fwd_1', 'ret_fwd_3', 'ret_fwd_6')} from (select symbol, date, {_FWD} from bal window w as (partition by symbol order by date))", "bal"))
def _(s, d):
    b = time_series.balanced(sample.panel(s, d).select("symbol", "date", "price"), sample.grid(sample.lines(s, d)))
    return six(point_in_time.with_forward_returns(b), ["symbol", "date"], "ret_fwd_1", "ret_fwd_3", "ret_fwd_6")


# ---- membership --------------------------------------------------------------------------------------------------
_MEMBER = """with e as (select cast(ts as date) as date, cast(user_id as varchar) as u, event_type, user_id from events),
ev as (select u as symbol, date, cast(event_type = 'signup' as integer) as kind from e where event_type in ('signup', 'error')),
names as (select distinct u as symbol from e where user_id % 2 = 0 union select symbol from ev),
days as (select distinct date as as_of from e),
st as (select n.symbol, d.as_of, (select kind from ev where ev.symbol = n.symbol and ev.date > d.as_of order by date, kind limit 1) as next_kind from names n, days d),
m as (select as_of as date, symbol from st where case when next_kind is not null then next_kind = 0 else cast(symbol as bigint) % 2 = 0 and symbol in (select u from e) end)
"""


def _members(s: SparkSession, d: str) -> DataFrame:
    today, log = sample.changes(s, d)
    days = sample.table(s, d, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    return membership.membership_asof(today, log, days)


@add("membership_asof", _MEMBER + "select * from m")
def _(s, d):
    return _members(s, d)


@add("membership_counts", _MEMBER + "select date, count(distinct symbol) as names from m group by date")
def _(s, d):
    return _members(s, d).groupBy("date").agg(F.countDistinct("symbol").alias("names"))


# ---- statements, vendors, cleaning -------------------------------------------------------------------------------
_ST = "o as (select o_custkey as symbol, year(o_orderdate) as fy, quarter(o_orderdate) as period, cast(o_orderdate as date) as accepted, cast(round(o_totalprice*100) as bigint) as cents, o_orderkey as okey, o_orderstatus as st from orders)"
_FIRST = "(select symbol, fy, period, arg_min(cents, (accepted, cents, okey)) as {0}_cents, arg_min(okey, (accepted, cents, okey)) as {0}_key from o where st = '{1}' group by all)"


@add("combined_filings", f"with {_ST}, k as (select symbol, fy, period, max(accepted) as accepted from o where st in ('O', 'F', 'P') group by all) select symbol, fy, period, k.accepted, income_cents, income_key, balance_cents, balance_key from k left join {_FIRST.format('income', 'O')} a using (symbol, fy, period) left join {_FIRST.format('balance', 'F')} b using (symbol, fy, period)")
def _(s, d):
    day = F.col("o_orderdate").cast("date")
    o = sample.table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.year(day).cast("long").alias("fy"), F.quarter(day).cast("long").alias("period"), day.alias("accepted"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderkey").alias("okey"), "o_orderstatus")
    part = lambda st, name: o.where(F.col("o_orderstatus") == st).withColumnsRenamed({"cents": f"{name}_cents", "okey": f"{name}_key"})
    st = {"income": part("O", "income"), "balance": part("F", "balance"), "cashflow": part("P", "cash")}
    fields = {"income": ["income_cents", "income_key"], "balance": ["balance_cents", "balance_key"], "cashflow": []}
    return point_in_time.combined_statements(st, fields, ["symbol", "fy", "period"], "accepted")


_VEND = "vb as (select symbol, date, price*(case when (symbol+month(date)+year(date)*12) % 37 = 0 then 1.7::double when symbol % 11 = 0 and (symbol+month(date)+year(date)*12) % 2 = 0 then 1.15::double else 1.0::double end) as price_b from p), ob0 as (select symbol, date, price, price_b, price/nullif(lag(price) over w,0)-1 as ret_a, price_b/nullif(lag(price_b) over w,0)-1 as ret_b from p join vb using (symbol, date) window w as (partition by symbol order by date)), ob as (select *, abs(ret_a-ret_b) as abs_diff from ob0)"
_REP = "rep as (select symbol, count(*) as n, quantile_cont(abs_diff, 0.5) as median_diff, quantile_cont(abs_diff, 0.95) as p95_diff, max(abs_diff) as max_diff, covar_samp(ret_a, ret_b)/nullif(stddev_samp(ret_a)*stddev_samp(ret_b),0) as corr from ob where abs_diff is not null group by symbol)"


def _more(base: str, *ctes: str) -> str:
    """query() text with further expressions before its last select."""
    head, _, body = base.rpartition("\n")
    return head + ",\n" + ",\n".join(ctes) + "\n" + body


def _observed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = sample.panel(s, d).select("symbol", "date", "price")
    return p, point_in_time.vendor_observations(p, sample.vendor_b(p), "price", "price_b")


@add("vendor_compare", _more(query(f"select symbol, date, {sixed('ret_a', 'ret_b', 'abs_diff')} from ob", "p"), _VEND))
def _(s, d):
    return six(_observed(s, d)[1], ["symbol", "date"], "ret_a", "ret_b", "abs_diff")


@add("vendor_report", _more(query(f"select symbol, n, {sixed('median_diff', 'p95_diff', 'max_diff', 'corr')}, coalesce(corr < 0.95, false) or max_diff > 0.10 as flag from rep", "p"), _VEND, _REP))
def _(s, d):
    return six(point_in_time.vendor_report(_observed(s, d)[1]), ["symbol", "n", "flag"], "median_diff", "p95_diff", "max_diff", "corr")


for _name, _least in (("clean_panel", 0.8), ("clean_panel_default", 0.5)):

    @add(_name, _more(query(f"select k.symbol, k.date, k.suspect_month, {r6('k.price')} as price, {sixed('ret_fwd_1', 'ret_fwd_3', 'ret_fwd_6')} from k join f on k.symbol = f.symbol and k.date = f.date", "p", "grid"), _VEND, _REP,
         f"k0 as (select p.symbol, p.date, coalesce(ob.abs_diff > 0.5, false) as suspect_month, p.price from p left join ob using (symbol, date) where p.symbol not in (select symbol from rep where corr < {_least} and median_diff > 0.05))", "k as (select symbol, date, suspect_month, case when not suspect_month then price end as price from k0)",
         f"f as (select symbol, date, {_FWD} from (select s.symbol, g.date, k.price from (select distinct symbol from k) s cross join grid g left join k on k.symbol = s.symbol and k.date = g.date) window w as (partition by symbol order by date))"))
    def _(s, d, least=_least):
        p, ob = _observed(s, d)
        c = point_in_time.cleaned(p, ob, point_in_time.vendor_report(ob), sample.grid(sample.lines(s, d)), corrupt=(F.col("corr") < least) & (F.col("median_diff") > 0.05))
        return six(c, ["symbol", "date", "suspect_month"], "price", "ret_fwd_1", "ret_fwd_3", "ret_fwd_6")


# ---- cross section -----------------------------------------------------------------------------------------------
@add("winsorize", query(f"select symbol, date, {r6('least(greatest(f4, lo), hi)')} as f4 from (select * from p where f4 is not null) join (select date, quantile_cont(f4, 0.01) as lo, quantile_cont(f4, 0.99) as hi from p group by date) using (date) union all select symbol, date, null from p where f4 is null", "p"))
def _(s, d):
    return six(cross_section.winsorise(sample.panel(s, d), "f4", ["date"]), ["symbol", "date"], "f4")


for _ddof, _name, _f in ((0, "zscore_pop", "stddev_pop"), (1, "zscore_samp", "stddev_samp")):

    @add(_name, query(f"select symbol, date, {r6(f'(f1-avg(f1) over w)/nullif({_f}(f1) over w,0)')} as z from p window w as (partition by date)", "p"))
    def _(s, d, ddof=_ddof):
        return out(sample.panel(s, d), "symbol", "date", z=cross_section.zscore("f1", ["date"], ddof))


@add("pct_rank", query(f"select symbol, date, {r6('(' + rank('f4', 'date') + ')/nullif(count(f4) over (partition by date),0)')} as rk from p", "p"))
def _(s, d):
    return out(sample.panel(s, d), "symbol", "date", rk=cross_section.pct_rank("f4", ["date"]))


@add("avg_rank", query(f"select symbol, date, {rank('f1', 'date')} as rk from p", "p"))
def _(s, d):
    return sample.panel(s, d).select("symbol", "date", cross_section.avg_rank("f1", ["date"]).alias("rk"))


for _n in (5, 10):

    @add(f"bucket_{'q' if _n == 5 else 'd'}{_n}", query(f"select symbol, date, {bucket('f1', 'date', _n)} as bucket from p", "p"))
    def _(s, d, n=_n):
        return sample.panel(s, d).select("symbol", "date", cross_section.bucket("f1", ["date"], "symbol", n).alias("bucket"))


@add("topn_per_month", query("select symbol, date, mcap, cast(rank as integer) as rank from (select symbol, date, mcap, row_number() over (partition by date order by mcap desc, symbol) as rank from p) where rank <= 20", "p"))
def _(s, d):
    return cross_section.top_n(sample.panel(s, d), "mcap", ["date"], "symbol", 20).select("symbol", "date", "mcap", "rank")


@add("screener_top_by_cap", "select p_partkey as symbol, p_retailprice as price, cast(row_number() over (order by p_retailprice desc, p_partkey) as integer) as rank from part where regexp_matches(p_brand, '^[A-Za-z]+#[0-9]{2}$') order by p_retailprice desc, p_partkey limit 50")
def _(s, d):
    top = sample.table(s, d, "part").where(F.col("p_brand").rlike("^[A-Za-z]+#[0-9]{2}$")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    from pyspark.sql.window import Window

    return top.select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))  # fifty rows


@add("keep_first_duplicates", "select symbol, date, cents from (select o_custkey as symbol, cast(o_orderdate as date) as date, cast(round(o_totalprice*100) as bigint) as cents, row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey) as n from orders) where n = 1")
def _(s, d):
    o = sample.table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    return cross_section.keep_first(o, ["symbol", "date"], "o_orderkey").select("symbol", "date", "cents")


# ---- time series -------------------------------------------------------------------------------------------------
_PF = "w as (partition by symbol order by date)"


@add("momentum", query("select symbol, date, " + ", ".join(f"{r6(f'lag(price,1) over w/nullif(lag(price,{k}) over w,0)-1')} as mom_{k}_1" for k in (12, 6, 3)) + f" from p window {_PF}", "p"))
def _(s, d):
    return six(signals.price_factors(sample.panel(s, d)), ["symbol", "date"], "mom_12_1", "mom_6_1", "mom_3_1")


@add("rolling_vol", query(f"select symbol, date, case when count(r1) over v >= 6 then {r6('stddev_samp(r1) over v * sqrt(12)')} end as vol_12m from (select symbol, date, price/nullif(lag(price) over w,0)-1 as r1 from p window {_PF}) window v as (partition by symbol order by date rows between 11 preceding and current row)", "p"))
def _(s, d):
    return six(signals.price_factors(sample.panel(s, d)), ["symbol", "date"], "vol_12m")


@add("short_term_reversal", query(f"select symbol, date, {r6('-(price/nullif(lag(price) over w,0)-1)')} as st_rev from p window {_PF}", "p"))
def _(s, d):
    return six(signals.price_factors(sample.panel(s, d)), ["symbol", "date"], "st_rev")


@add("value_refresh", query(f"select symbol, date, {r6('r')} as price_ratio, {r6('f1*r')} as f1, {r6('mcap/nullif(r,0)')} as mcap_live, {r6('-ln(mcap/nullif(r,0))')} as size from (select *, coalesce(case when lag(price,3) over w is not null then least(greatest(lag(price,3) over w/nullif(price,0),0.1),10) end,1) as r from p window {_PF})", "p"))
def _(s, d):
    p = sample.panel(s, d).withColumn("px_filing", time_series.shift("price", 3, ["symbol"]))
    return six(point_in_time.refreshed_value(p, "price", "px_filing", "mcap", ["f1"]), ["symbol", "date"], "price_ratio", "f1", "mcap_live", "size")


_ACT = "a as (select user_id as symbol, cast(ts as date) as date, case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as s from events), g as (select cast(unnest(generate_series((select min(date) from a), (select max(date) from a), interval 1 day)) as date) as date)"


@add("action_revisions", f"with {_ACT} select f.symbol, g.date, case when g.date >= first then cast(coalesce(sum(s) filter (a.date > g.date - 3), 0) as bigint) end as net_3, case when g.date >= first then cast(coalesce(sum(s) filter (a.date > g.date - 6), 0) as bigint) end as net_6, case when g.date >= first then {r6('sum(s) filter (a.date > g.date - 12)/nullif(cast(sum(abs(s)) filter (a.date > g.date - 12) as double),0)')} end as breadth from (select symbol, min(date) as first from a group by symbol) f cross join g left join a on a.symbol = f.symbol and a.date <= g.date and a.date > g.date - 12 and s <> 0 group by f.symbol, g.date, first")
def _(s, d):
    a = sample.actions(s, d)
    return signals.revisions(a, sample.day_grid(a), {"net_3": 3, "net_6": 6}, 12).select("symbol", "date", "net_3", "net_6", rounded("breadth").alias("breadth"))


@add("family_composite", _more(query(f"select date, symbol, family, {r6('(' + rank('mean_rank', 'date, family') + ')/nullif(count(mean_rank) over (partition by date, family),0)')} as score from sc", "p"),
     "lg as (" + " union all ".join(f"select date, symbol, '{c}' as component, {c} as v from p" for c in FACTORS) + ")", "wn as (select date, symbol, component, case when v is not null then least(greatest(v, lo), hi) end as v from lg join (select date, component, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from lg group by all) using (date, component))",
     f"rk as (select date, symbol, component, ({rank('v', 'date, component')})/nullif(count(v) over (partition by date, component),0) as rk from wn)", "fam(family, component) as (values " + ", ".join(f"('{k}', '{c}')" for k, cs in FAMILIES.items() for c in cs) + ")",
     f"sc as (select date, symbol, family, {r6('avg(rk)', 10)} as mean_rank from rk join fam using (component) group by all)"))
def _(s, d):
    return six(signals.family_composites(sample.panel(s, d), FAMILIES, ["date"]), ["date", "symbol", "family"], "score")


# ---- information coefficients ------------------------------------------------------------------------------------
@add("rank_ic_monthly", query(f"select factor, date, n, {r6('ic')} as ic from ics", "ics"))
def _(s, d):
    return six(monthly_ic(s, d), ["factor", "date", "n"], "ic")


_STATS = "{k}, count(*) as n, avg(ic) as mean, stddev_samp(ic) as std, avg(case when ic > 0 then 1.0::double else 0.0::double end) as hit, avg(ic)/nullif(stddev_samp(ic),0) as ir, avg(ic)/nullif(stddev_samp(ic),0)*sqrt(count(*)) as t"


@add("rank_ic_stats", query(f"select factor, n, {sixed('mean', 'std', 'hit', 'ir', 't')} from (select {_STATS.format(k='factor')} from ics where ic is not null group by factor)", "ics"))
def _(s, d):
    return six(stats.series_stats(monthly_ic(s, d), "ic", ["factor"]), ["factor", "n"], "mean", "std", "hit", "ir", "t")


def _ic_sql(source: str, keys: str, x: str = "score", y: str = "r", least: int = 20) -> tuple[str, str]:
    ranks = f"select {keys}, {rank(x, keys)} as rx, {rank(y, keys)} as ry from {source} where {x} is not null and {y} is not null"
    return f"rk as ({ranks})", f"ic as (select {keys}, count(*) as n, (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0) as ic from rk group by {keys} having count(*) >= {least})"


_LAGS = 12

for _name, _n in (("ic_decay", _LAGS), ("ic_decay_12", _LAGS)):

    @add(_name, _more(query(f"select cast(lag as integer) as lag, n, {sixed('mean', 'std', 'hit', 'ir', 't')} from (select {_STATS.format(k='lag')} from ic where ic is not null group by lag)", "comp"),
         "src as (" + " union all ".join(f"select {k} as lag, date, score, lead(ret, {k - 1}) over (partition by symbol order by date) as r from comp" for k in range(1, _n + 1)) + ")", *_ic_sql("src", "lag, date")))
    def _(s, d, lags=_n):
        return six(signals.ic_decay(composite(s, d), "score", "ret", lags), ["lag", "n"], "mean", "std", "hit", "ir", "t")


_COMPOUND = lambda h: "*".join(f"(1+lead(ret,{k}) over (partition by symbol order by date))" for k in range(h)) + "-1"


@add("ic_horizons", _more(query(f"select cast(h as integer) as h, n, {sixed('mean', 'std', 'hit', 'ir', 't')} from (select {_STATS.format(k='h')} from ic where ic is not null group by h)", "comp"),
     "src as (" + " union all ".join(f"select {h} as h, date, score, {r6(_COMPOUND(h), 10)} as r from comp" for h in (1, 2, 3, 6, 12)) + ")", *_ic_sql("src", "h, date")))
def _(s, d):
    c = composite(s, d)
    for h in (1, 2, 3, 6, 12):
        c = signals.compounded_forward(c, "ret", h)
    long = c.select("date", "score", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), rounded(f"ret_{h}", 10).alias("r")) for h in (1, 2, 3, 6, 12)))).alias("e")).select("date", "score", "e.h", "e.r")
    return six(stats.series_stats(stats.rank_ic(long, "score", "r", ["h", "date"]), "ic", ["h"]), ["h", "n"], "mean", "std", "hit", "ir", "t")


@add("ic_two_month", _more(query(f"select date, n, {r6('ic')} as ic from ic", "comp"), "src as (select date, score, lead(ret,1) over (partition by symbol order by date) as r from comp)", *_ic_sql("src", "date")))
def _(s, d):
    c = composite(s, d).withColumn("r", time_series.shift("ret", -1, ["symbol"]))
    return six(stats.rank_ic(c, "score", "r", ["date"]), ["date", "n"], "ic")


@add("pooled_ic", f"with b as (select d.doc_id, n_chars, cast(quality as double) as quality, d.lang from documents d join labels using (doc_id)), m as (select lang, quantile_cont(cast(n_chars as double), 0.5) as mx from b group by lang), rk as (select b.lang, {rank('n_chars', 'b.lang')} as rx, {rank('quality', 'b.lang')} as ry, (n_chars > mx) = (quality > 0) as h from b join m using (lang)), g as (select lang, count(*) as n, (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0) as ic, avg(case when h then 1.0::double else 0.0::double end) as hit from rk group by lang having count(*) >= 30) select lang, n, {r6('ic')} as ic, {r6('hit')} as hit, {r6('ic*sqrt(n-2)/nullif(sqrt(1-ic*ic),0)')} as t from g")
def _(s, d):
    b = sample.table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang").join(sample.table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    return six(stats.pooled_rank_ic(b, "n_chars", "quality", ["lang"]), ["lang", "n"], "ic", "hit", "t")


# ---- fractiles and screens ---------------------------------------------------------------------------------------
for _cw in (False, True):
    _r = "sum(ret*mcap)/nullif(sum(mcap),0)" if _cw else "avg(ret)"

    @add(f"fractile_{'cw' if _cw else 'ew'}", query(f"select date, 5-bucket as fractile, {r6(_r)} as ret, count(*) as names from b5 group by date, bucket", "b5"))
    def _(s, d, cw=_cw):
        return six(books.fractiles(composite(s, d), "score", "ret", "mcap", 5, cw), ["date", "fractile", "names"], "ret")


_PERF = "{k}, count(*) as n, product(1+x)-1 as total, case when product(1+x) > 0 then pow(product(1+x), 12.0::double/count(*))-1 end as cagr, stddev_samp(x)*sqrt(12) as vol, avg(x)*12/nullif(stddev_samp(x)*sqrt(12),0) as sharpe, avg(case when x > 0 then 1.0::double else 0.0::double end) as hit, min(dd) as max_drawdown"
_DD = "gr as (select *, product(1+x) over (partition by {k} order by date rows unbounded preceding) as g from src where x is not null), dds as (select *, g/nullif(max(g) over (partition by {k} order by date rows unbounded preceding),0)-1 as dd from gr)"
_PCOLS = ("total", "cagr", "vol", "sharpe", "hit", "max_drawdown")


@add("fractile_stats", _more(query(f"select fractile, n, {sixed(*_PCOLS)} from (select {_PERF.format(k='fractile')} from dds group by fractile)", "b5"), "src as (select 5-bucket as fractile, date, avg(ret) as x from b5 group by date, bucket)", _DD.format(k="fractile")))
def _(s, d):
    return six(metrics.performance(books.fractiles(composite(s, d), "score", "ret", "mcap", 5, False), "ret", ["fractile"]), ["fractile", "n"], *_PCOLS)


@add("fractile_turnover", _more(query(f"select fractile, {r6('avg(traded)/2')} as turnover from (select fractile, traded, row_number() over (partition by fractile order by date) as k from tr) where k > 1 group by fractile", "b5"),
     "fw as (select 5-bucket as fractile, date, symbol, 1.0::double/count(*) over (partition by date, bucket) as w from b5)", "tr as (" + traded("fw", "fractile") + ")"))
def _(s, d):
    return six(books.name_turnover(composite(s, d), "score", "ret", "mcap", 5), ["fractile"], "turnover")


def _screen(s: SparkSession, d: str) -> DataFrame:
    ic = stats.series_stats(monthly_ic(s, d), "ic", ["factor"])
    rows = factor_long(s, d).where(complete("value", "ret"))
    rows = rows.withColumn("bucket", cross_section.bucket("value", ["factor", "date"], "symbol", 10))
    each = rows.where("bucket in (0, 9)").groupBy("factor", "date", "bucket").agg(F.avg("ret").alias("r"))
    wide = each.groupBy("factor", "date").agg(F.max(F.when(F.col("bucket") == 9, F.col("r"))).alias("top"), F.max(F.when(F.col("bucket") == 0, F.col("r"))).alias("bot"))
    spread = wide.groupBy("factor").agg((F.avg("top") * 12).alias("top_pa"), (F.avg("bot") * 12).alias("bot_pa"), (F.avg(F.col("top") - F.col("bot")) * 12).alias("spread_pa"))
    return ic.join(spread, "factor")


_SCREEN = _more(query(f"select factor, n, {sixed('mean', 'ir', 't', 'top_pa', 'bot_pa', 'spread_pa')} from (select {_STATS.format(k='factor')} from ics where ic is not null group by factor) join sp using (factor)", "ics"),
    f"bk as (select *, {bucket('value', 'factor, date', 10)} as bucket from long where value is not null and ret is not null)", "e as (select factor, date, avg(ret) filter (bucket = 9) as top, avg(ret) filter (bucket = 0) as bot from bk where bucket in (0, 9) group by factor, date)",
    "sp as (select factor, avg(top)*12 as top_pa, avg(bot)*12 as bot_pa, avg(top-bot)*12 as spread_pa from e group by factor)")


@add("screen_table", _SCREEN)
def _(s, d):
    return six(_screen(s, d), ["factor", "n"], "mean", "ir", "t", "top_pa", "bot_pa", "spread_pa")


@add("significance_table", f"select * from ({_SCREEN}) where abs(t) >= 1.5 or spread_pa >= 0.3")
def _(s, d):
    return six(_screen(s, d).where((F.abs(rounded("t")) >= 1.5) | (rounded("spread_pa") >= 0.3)), ["factor", "n"], "mean", "ir", "t", "top_pa", "bot_pa", "spread_pa")


_Z0 = ", ".join(f"({x}-avg({x}) over w)/nullif(stddev_pop({x}) over w,0) as {x}" for x in ("f1", "lm", "f2"))
_DM = (
    f"zs as (select date, sector, ret, {_Z0} from (select *, ln(greatest(mcap, 1)) as lm from lab join sec using (symbol) where ret is not null and f1 is not null and f2 is not null and mcap is not null) window w as (partition by date)), "
    "dm as (select date, ret-avg(ret) over w as y, f1-avg(f1) over w as x0, lm-avg(lm) over w as x1, f2-avg(f2) over w as x2 from zs window w as (partition by date, sector)), "
    "sm as (select date, count(*) as n, sum(x0*x0) as a00, sum(x0*x1) as a01, sum(x0*x2) as a02, sum(x1*x1) as a11, sum(x1*x2) as a12, sum(x2*x2) as a22, sum(x0*y) as b0, sum(x1*y) as b1, sum(x2*y) as b2 from dm group by date having count(*) >= 30)"
)
_DET = "a00*(a11*a22-a12*a12)-a01*(a01*a22-a12*a02)+a02*(a01*a12-a11*a02)"


def _pure_raw(s: SparkSession, d: str) -> DataFrame:
    rows = sample.labelled(s, d).join(sample.sectors(s, d), "symbol").withColumn("lm", F.ln(F.greatest("mcap", F.lit(1.0))))
    return stats.pure_and_raw_returns(rows, "ret", "f1", ["lm", "f2"], ["date"], "sector")


@add("pure_factor_return", _more(query(f"select date, n, case when abs({_DET}) > 1e-12*abs(a00*a11*a22) then {r6(f'(b0*(a11*a22-a12*a12)-a01*(b1*a22-a12*b2)+a02*(b1*a12-a11*b2))/nullif({_DET},0)')} end as coef from sm", "lab", "sec"), _DM))
def _(s, d):
    return out(_pure_raw(s, d), "date", "n", coef="pure")


@add("raw_factor_return", _more(query(f"select date, count(*) as n, {r6('regr_slope(ret, f1)')} as coef from zs group by date having count(*) >= 30", "lab", "sec"), _DM.partition(", dm as (")[0]))
def _(s, d):
    return out(_pure_raw(s, d), "date", "n", coef="raw")


@add("z_composite", query(f"select date, symbol, {r6('score')} as score from comp", "comp"))
def _(s, d):
    return six(composite(s, d), ["date", "symbol"], "score")


@add("factor_correlations", query("select a, b, " + r6("corr") + " as corr from (select x.factor as a, y.factor as b, covar_samp(x.value, y.value)/nullif(stddev_samp(x.value)*stddev_samp(y.value),0) as corr from long x join long y on x.date = y.date and x.symbol = y.symbol and x.factor < y.factor where x.value is not null and y.value is not null group by x.factor, y.factor)", "long"))
def _(s, d):
    return six(stats.correlations(sample.panel(s, d), FACTORS), ["a", "b"], "corr")


_LAGGED = [f"{f}_{k}" for f in FACTORS for k in range(7)]
_LAG_SQL = " union all ".join(
    f"select symbol, date, '{f}_{k}' as name, {FACTORS.index(f) * 7 + k} as at, lag({f}, {k}) over (partition by symbol order by date) as v from p" for f in FACTORS for k in range(7)
)


@add(
    "lagged_correlations",
    _more(
        query(
            f"select x.name as a, y.name as b, count(*) as n, {r6('covar_samp(x.v, y.v)/nullif(stddev_samp(x.v)*stddev_samp(y.v),0)')} as corr "
            "from lg x join lg y using (symbol, date) where x.at < y.at and x.v is not null and y.v is not null group by all",
            "p",
        ),
        f"lg as materialized ({_LAG_SQL})",
    ),
)
def _(s, d):
    """Every factor with every factor's last six values: 35 columns, one matrix a task."""
    rows = sample.panel(s, d).withColumns({f"{f}_{k}": time_series.shift(f, k, ["symbol"]) for f in FACTORS for k in range(7)})
    return six(stats.correlations(rows, _LAGGED), ["a", "b", "n"], "corr")


# ---- books -------------------------------------------------------------------------------------------------------
@add("long_only_d10_ew", query(f"select date, names, {sixed('gross', 'traded')} from dbook", "dbook"))
def _(s, d):
    return six(books.long_book(composite(s, d), "score", "ret", "mcap", 10, False), ["date", "names"], "gross", "traded")


@add("long_only_q5_cw", query(f"select date, names, {sixed('gross', 'traded')} from qbook", "qbook"))
def _(s, d):
    return six(books.long_book(composite(s, d), "score", "ret", "mcap", 5, True), ["date", "names"], "gross", "traded")


@add("long_short_q5_ew", query(f"select date, {sixed('long_leg', 'short_leg', 'gross', 'top_traded', 'bot_traded', 'traded')} from book", "book"))
def _(s, d):
    return six(books.long_short(composite(s, d), "score", "ret", "mcap", 5, False), ["date"], "long_leg", "short_leg", "gross", "top_traded", "bot_traded", "traded")


def _bn(months: int) -> str:
    return (
        "bn0 as (select b.*, m.ret as mkt from book b join mkt m using (date)), "
        f"bn1 as (select *, case when count(*) over v >= {months} then covar_samp(long_leg, mkt) over v/nullif(var_samp(mkt) over v,0) end as bl, case when count(*) over v >= {months} then covar_samp(short_leg, mkt) over v/nullif(var_samp(mkt) over v,0) end as bs from bn0 window v as (order by date rows between {months - 1} preceding and current row)), "
        "bn2 as (select *, lag(case when bl/nullif(bs,0) is not null then least(greatest(bl/nullif(bs,0), 0.25), 4) end) over (order by date) as scale from bn1)"
    )


for _name, _months in (("beta_neutral", 36), ("beta_neutral_36", 36)):

    @add(_name, _more(query(f"select date, {r6('scale')} as scale, {r6('long_leg-scale*short_leg')} as gross, {r6('top_traded+bot_traded*abs(coalesce(scale,1))')} as traded from bn2", "book", "mkt"), _bn(_months)))
    def _(s, d, months=_months):
        p = sample.labelled(s, d)
        return six(books.beta_neutral(books.long_short(composite(s, d), "score", "ret", "mcap", 5, False), books.universe_return(p, "ret", "mcap"), months), ["date"], "scale", "gross", "traded")


_SN = (f"sb as (select *, {bucket('score', 'date, sector', 5)} as bk from comp join sec using (symbol) where score is not null and ret is not null)", "sx as (select date, symbol, sector, ret, case when bk = 0 then 'bot' else 'top' end as side from sb where bk in (0, 4))",
       "sn as (select x.*, n_sec, 1.0::double/count(*) over (partition by x.date, sector, side)/n_sec as w from sx x join (select date, count(distinct sector) as n_sec from sx group by date) using (date))", "st as (" + traded("sn", "side") + ")")


@add("sector_neutral", _more(query(f"select g.date, n_sec, {r6('gross')} as gross, {r6('tr')} as traded from (select date, sum(case when side = 'top' then w else -w end*ret) as gross, cast(max(n_sec) as integer) as n_sec from sn group by date) g join (select date, sum(traded) as tr from st group by date) t using (date)", "comp", "sec"), *_SN))
def _(s, d):
    c = composite(s, d).join(sample.sectors(s, d), "symbol")
    return six(books.sector_neutral(c, "score", "ret", "mcap", "sector", 5), ["date", "n_sec"], "gross", "traded")


@add("traded_notional", query(f"select date, {r6('traded')} as traded from qt", "qt"))
def _(s, d):
    rows = books.bucketed(composite(s, d), "score", "ret", "mcap", 5).where("bucket = 4")
    return six(books.traded(books.weights(rows, ["date"], "mcap")), ["date"], "traded")


@add("universe_return_ew", query(f"select date, {r6('avg(ret)')} as ret from lab where ret is not null group by date", "lab"))
def _(s, d):
    return six(books.universe_return(sample.labelled(s, d), "ret"), ["date"], "ret")


@add("universe_return_cw", query(f"select date, {r6('ret')} as ret from mkt", "mkt"))
def _(s, d):
    return six(books.universe_return(sample.labelled(s, d), "ret", "mcap"), ["date"], "ret")


# ---- metrics -----------------------------------------------------------------------------------------------------
for _name in ("net_returns", "net_returns_all_costs"):

    @add(_name, query(f"select series, date, cost_bps, {r6('net')} as net from net", "net"))
    def _(s, d):
        return six(metrics.net_returns(series(s, d), COSTS), ["series", "date", "cost_bps"], "net")


_NETP = ("src as (select series || ':' || cast(cast(cost_bps as integer) as varchar) as sid, series, cost_bps, date, net as x from net)", _DD.format(k="sid"))


@add("cost_sensitivity_all_costs", _more(query(f"select series, cost_bps, n, {sixed('cagr', 'vol', 'sharpe')} from (select {_PERF.format(k='series, cost_bps')} from dds group by series, cost_bps)", "net"), *_NETP))
def _(s, d):
    return six(metrics.performance(metrics.net_returns(series(s, d), COSTS), "net", ["series", "cost_bps"]), ["series", "cost_bps", "n"], "cagr", "vol", "sharpe")


_COST = ("cagr", "vol", "sharpe", "max_drawdown", "turnover_pa", "cost_drag", "alpha", "beta")
_COST_SQL = (
    f"pm as (select {_PERF.format(k='series, cost_bps')} from dds group by series, cost_bps)",
    "mv as (select series, avg(traded)*6 as turnover_pa from ser group by series)",
    "cp as (select series, case when count(*) >= 12 then regr_slope(gross, m.ret) end as beta, case when count(*) >= 12 then regr_intercept(gross, m.ret)*12 end as gross_alpha "
    "from ser join mkt m using (date) where gross is not null and m.ret is not null group by series)",
    "ct as (select pm.*, turnover_pa, turnover_pa*2*cost_bps/10000 as cost_drag, gross_alpha - turnover_pa*2*cost_bps/10000 as alpha, beta from pm join mv using (series) left join cp using (series))",
)


@add("cost_sensitivity", _more(query(f"select series, cost_bps, n, {sixed(*_COST)} from ct", "net", "mkt"), *_NETP, *_COST_SQL))
def _(s, d):
    market = books.universe_return(sample.labelled(s, d), "ret", "mcap").withColumnRenamed("ret", "mkt")
    return six(metrics.cost_table(series(s, d), market, COSTS, ["series"]), ["series", "cost_bps", "n"], *_COST)


@add("perf_metrics", _more(query(f"select series, n, {sixed(*_PCOLS)} from (select {_PERF.format(k='series')} from dds where cost_bps = 10 group by series)", "net"), *_NETP))
def _(s, d):
    return six(metrics.performance(metrics.net_returns(series(s, d), [10.0]), "net", ["series"]), ["series", "n"], *_PCOLS)


@add("gross_vs_net", query(f"select series, {r6('avg(gross)*12')} as gross_pa, {r6('avg(net)*12')} as net_pa, {r6('avg(gross)*12-avg(net)*12')} as drag_pa from net where cost_bps = 10 group by series", "net"))
def _(s, d):
    g = metrics.net_returns(series(s, d), [10.0]).groupBy("series").agg((F.avg("gross") * 12).alias("gross_pa"), (F.avg("net") * 12).alias("net_pa"))
    return six(g.withColumn("drag_pa", F.col("gross_pa") - F.col("net_pa")), ["series"], "gross_pa", "net_pa", "drag_pa")


@add("turnover_table", query(f"select series, count(*) as months, {r6('avg(traded)/2*12')} as turnover_pa, {r6('avg(traded)')} as avg_traded from (select *, row_number() over (partition by series order by date) as k from ser) where k > 1 group by series", "ser"))
def _(s, d):
    return six(metrics.turnover(series(s, d), ["series"]), ["series", "months"], "turnover_pa", "avg_traded")


@add("capm", query(f"select series, count(*) as n, {r6('regr_slope(gross, m.ret)')} as beta, {r6('regr_intercept(gross, m.ret)*12')} as alpha from ser join mkt m using (date) where gross is not null and m.ret is not null group by series", "ser", "mkt"))
def _(s, d):
    m = books.universe_return(sample.labelled(s, d), "ret", "mcap").withColumnRenamed("ret", "mkt")
    return six(stats.capm(series(s, d).join(m, "date"), "gross", "mkt", ["series"]), ["series", "n"], "beta", "alpha")


@add("biased_beta", query(f"select series, {r6('covar_samp(gross, m.ret)/nullif(var_pop(m.ret),0)')} as beta from ser join mkt m using (date) group by series", "ser", "mkt"))
def _(s, d):
    m = books.universe_return(sample.labelled(s, d), "ret", "mcap").withColumnRenamed("ret", "mkt")
    return six(series(s, d).join(m, "date").groupBy("series").agg(stats.biased_beta("gross", "mkt").alias("beta")), ["series"], "beta")


_SER = ("src as (select series, date, gross as x from ser)", _DD.format(k="series"))


@add("drawdown_series", _more(query(f"select series, date, {r6('dd')} as drawdown from dds", "ser"), *_SER))
def _(s, d):
    return six(time_series.with_drawdown(series(s, d).where("gross is not null"), "gross", ["series"]), ["series", "date"], "drawdown")


@add("growth_of_one", _more(query(f"select series, date, {r6('g', 2)} as growth from gr", "ser"), *_SER))
def _(s, d):
    return six(time_series.with_drawdown(series(s, d).where("gross is not null"), "gross", ["series"]), ["series", "date"], "growth")


@add("rolling_ic_12", query(f"select factor, date, case when count(ic) over v >= 6 then {r6('avg(ic) over v')} end as ic_12 from ics window v as (partition by factor order by date rows between 11 preceding and current row)", "ics"))
def _(s, d):
    return out(monthly_ic(s, d), "factor", "date", ic_12=time_series.rolling_mean("ic", ["factor"]))


# ---- adaptive weights --------------------------------------------------------------------------------------------
_AN = "an as (select date as anchor, block from (select date, min(date) over (partition by block) as first, block from (select date, (dense_rank() over (order by date)-1)//3 as block from (select distinct date from lab))) where date = first)"
_TR = (
    "t0 as (select factor, anchor, count(ic) as n, avg(ic) as mean, stddev_samp(ic) as std from an join ics on ics.date >= cast(anchor - interval 37 month as date) "
    "and ics.date < cast(anchor - interval 1 month as date) group by factor, anchor), "
    f"tr as (select t0.* from t0 join (select anchor from t0 group by anchor having min(n) >= 24 and count(*) = {len(FACTORS)}) using (anchor))"
)
_SW = (
    f"gr as (select anchor, factor, mean, std, n from an cross join (values {', '.join(f"('{f}')" for f in FACTORS)}) v(factor) left join tr using (anchor, factor)), "
    "sr as (select anchor, factor, n is not null as has_history, unnest([{'k': 'ew', 'raw': 1.0::double, 's': 0.0::double}, {'k': 'ic', 'raw': greatest(mean, 0), 's': 0.0::double}, "
    "{'k': 'ic_ir', 'raw': greatest(mean/nullif(std,0), 0), 's': 0.5::double}, "
    "{'k': 't2', 'raw': case when mean/nullif(std,0) > 0 then pow(mean/nullif(std,0)*sqrt(n), 2) else 0 end, 's': 0.5::double}]) as e from gr), "
    "sw as (select e.k as scheme, anchor, factor, has_history, e.s/count(*) over v + (1-e.s)*coalesce(coalesce(e.raw,0)/nullif(sum(coalesce(e.raw,0)) over v,0), 1.0::double/count(*) over v) as weight "
    "from sr window v as (partition by e.k, anchor))"
)
_BLOCKS = "bl as (select date, max(anchor) as anchor from (select distinct date from lab) join an on anchor <= date group by date)"


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return signals.rebalance_blocks(sample.labelled(s, d).select("date"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).where("date = anchor").select("date")


def _trailing(s: SparkSession, d: str) -> DataFrame:
    return signals.trailing_ic(monthly_ic(s, d), _anchors(s, d), FACTORS)


def _weights(s: SparkSession, d: str) -> DataFrame:
    return signals.scheme_weights(_trailing(s, d), _anchors(s, d), FACTORS)


@add("trailing_ic_stats", _more(query(f"select factor, anchor, n, {sixed('mean', 'std')} from tr", "ics"), _AN, _TR))
def _(s, d):
    return six(_trailing(s, d), ["factor", "anchor", "n"], "mean", "std")


@add("scheme_weights", _more(query(f"select scheme, anchor, factor, has_history, {r6('weight')} as weight from sw", "ics"), _AN, _TR, _SW))
def _(s, d):
    return six(_weights(s, d), ["scheme", "anchor", "factor", "has_history"], "weight")


_LONG_Z = " union all ".join(f"select date, symbol, '{f}' as factor, z_{f} as z from zed" for f in FACTORS)


@add(
    "weighted_composite",
    _more(
        query(
            f"select scheme, z.date, symbol, {r6('sum(z*weight)/nullif(sum(case when z is not null then weight end),0)')} as score "
            f"from ({_LONG_Z}) z join bl using (date) join sw on bl.anchor = sw.anchor and z.factor = sw.factor group by scheme, z.date, symbol",
            "ics", "zed",
        ),
        _AN, _TR, _SW, _BLOCKS,
    ),
)
def _(s, d):
    z = sample.labelled(s, d).withColumns({f"z_{f}": cross_section.zscore(f, ["date"], 1) for f in FACTORS})
    z = z.select("date", "symbol", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"z_{f}").alias("z")) for f in FACTORS))).alias("e")).select("date", "symbol", "e.factor", "e.z")
    return six(signals.weighted_composite(z, _weights(s, d), _blocks(s, d)), ["scheme", "date", "symbol"], "score")


@add("oos_start", _more(query("select max(first) as start from (select scheme, min(anchor) as first from sw where has_history group by scheme)", "ics"), _AN, _TR, _SW))
def _(s, d):
    first = _weights(s, d).where("has_history").groupBy("scheme").agg(F.min("anchor").alias("first"))
    return first.agg(F.max("first").alias("start"))


@add("rebalance_blocks", query("select date, cast(block as integer) as block, min(date) over (partition by block) as anchor from (select date, (dense_rank() over (order by date)-1)//3 as block from (select distinct date from lab))", "lab"))
def _(s, d):
    return signals.rebalance_blocks(sample.labelled(s, d).select("date"))


# ---- shapes, lookups, scalars ------------------------------------------------------------------------------------
@add("sector_map_lookup", "select c_custkey as symbol, coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, case when c_custkey % 3 <> 2 then n_name end, 'Unknown') as sector from customer join nation on c_nationkey = n_nationkey")
def _(s, d):
    c, n = sample.table(s, d, "customer"), sample.table(s, d, "nation")
    profiles = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"))
    members = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).where("c_custkey % 3 <> 2").select(F.col("c_custkey").alias("symbol"), F.col("n_name").alias("sector"))
    return point_in_time.sector_lookup(c.select(F.col("c_custkey").alias("symbol")), profiles, members)


@add("unpivot_prices", query("select symbol, date, field, " + r6("value") + " as value from (select symbol, date, 'price' as field, price as value from p union all select symbol, date, 'mcap', mcap from p union all select symbol, date, 'f4', f4 from p) where value is not null", "p"))
def _(s, d):
    long = sample.panel(s, d).select("symbol", "date", "price", "mcap", "f4").unpivot(["symbol", "date"], ["price", "mcap", "f4"], "field", "value")
    return six(long.where("value is not null"), ["symbol", "date", "field"], "value")


@add("pivot_fractiles", query("select date, " + ", ".join(f"{r6(f'avg(ret) filter (bucket = {5 - k})')} as f{k}" for k in range(1, 6)) + " from b5 group by date", "b5"))
def _(s, d):
    wide = books.fractiles(composite(s, d), "score", "ret", "mcap", 5, False).groupBy("date").pivot("fractile", [1, 2, 3, 4, 5]).agg(F.first("ret"))
    return wide.select("date", *(rounded(F.col(str(k))).alias(f"f{k}") for k in range(1, 6)))


_OM = "x as (select o_custkey as symbol, cast(o_orderdate as date) as date, max(cast(round(o_totalprice*100) as bigint)) as a from orders where o_orderstatus = 'F' group by all), y as (select o_custkey as symbol, cast(o_orderdate as date) as date, count(*) as b from orders where o_orderstatus = 'O' group by all)"


@add("outer_merge_consolidate", f"with {_OM} select symbol, date, a, b from x full join y using (symbol, date)")
def _(s, d):
    o = sample.table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), "o_orderstatus")
    x = o.where("o_orderstatus = 'F'").groupBy("symbol", "date").agg(F.max("c").alias("a"))
    y = o.where("o_orderstatus = 'O'").groupBy("symbol", "date").agg(F.count("*").alias("b"))
    rows = x.select("symbol", "date", "a", F.lit(None).cast("long").alias("b"), F.lit(0).alias("src")).unionByName(y.select("symbol", "date", F.lit(None).cast("long").alias("a"), "b", F.lit(1).alias("src")))
    return point_in_time.consolidated(rows, ["symbol", "date"], ["a", "b"], ["src"])


@add("first_non_null", query(f"select symbol, {r6('arg_min(f4, date)')} as first_f4, {r6('arg_max(price, date)')} as last_price from p group by symbol", "p"))
def _(s, d):
    g = sample.panel(s, d).groupBy("symbol").agg(F.min_by("f4", F.when(F.col("f4").isNotNull(), F.col("date"))).alias("a"), F.max_by("price", F.when(F.col("price").isNotNull(), F.col("date"))).alias("b"))
    return out(g, "symbol", first_f4="a", last_price="b")


@add("missing_symbols", "select c_custkey as symbol from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey % 3 <> 0)")
def _(s, d):
    o = sample.table(s, d, "orders").where("o_orderstatus = 'P' and o_custkey % 3 <> 0").select(F.col("o_custkey").alias("symbol"))
    return sample.table(s, d, "customer").select(F.col("c_custkey").alias("symbol")).join(o, "symbol", "left_anti")


@add("coverage_stats", query("select date, 'f1' as column, " + r6("avg(cast(f1 is not null as double))") + " as coverage from p group by date union all select date, 'f4', " + r6("avg(cast(f4 is not null as double))") + " from p group by date", "p"))
def _(s, d):
    return six(point_in_time.coverage(sample.panel(s, d), ["f1", "f4"], ["date"]), ["date", "column"], "coverage")


@add("cache_keys", "select page_id, substr(sha1('pages|' || coalesce(url, '')), 1, 16) as cache_key from pages")
def _(s, d):
    return sample.table(s, d, "pages").select("page_id", cache_key(F.lit("pages"), F.coalesce("url", F.lit(""))).alias("cache_key"))


@add("parsed_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(s, d):
    return sample.table(s, d, "events").select("event_id", F.from_json("props", "k long").alias("j")).select("event_id", "j.k")


@add("complete_names_filter", query("select symbol, date from (select symbol, date, count(*) over (partition by date) as n from lab where f4 is not null and ret is not null) where n >= 50", "lab"))
def _(s, d):
    from pyspark.sql.window import Window

    rows = sample.labelled(s, d).where(complete("f4", "ret"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("date"))).where("n >= 50").select("symbol", "date")


# ---- text and learning -------------------------------------------------------------------------------------------
_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')"
_HIT = {c: "len(list_filter(w, lambda x: x in (" + ", ".join(f"'{x}'" for x in ws) + ")))" for c, ws in LEXICON.items()}


@add("doc_sentiment", f"with t as (select doc_id, {_TOK} as w from documents), s as (select doc_id, cast(len(w) as bigint) as word_count, " + ", ".join(f"coalesce(cast({h} as double)*100/nullif(len(w),0),0) as {c}" for c, h in _HIT.items()) + f" from t) select doc_id, word_count, {sixed(*LEXICON)}, {r6('positive-negative')} as net from s")
def _(s, d):
    return six(text.sentiment(sample.table(s, d, "documents"), "doc_id", "text", LEXICON, "positive", "negative"), ["doc_id", "word_count"], *LEXICON, "net")


_FOLD = "ix as (select date, row_number() over (order by date)-1 as idx from (select distinct date from lab)), st as (select unnest(range(60, (select max(idx) from ix)+1, 12)) as start)"


@add("wf_fold_assignment", _more(query("select fold, date, role from (select cast((start-60)//12 as integer) as fold, date, case when idx >= start and idx < start+12 then 'test' when idx < start-1 and idx >= start-13 then 'validation' when idx < start-13 then 'train' end as role from ix, st) where role is not null", "lab"), _FOLD))
def _(s, d):
    return ml.folds(sample.labelled(s, d).select("date"))


def _walk_forward(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = sample.labelled(s, d)
    return ml.walk_forward(p, FACTORS, "ret", ml.folds(p.select("date")))


@add("wf_predictions")
def _(s, d):
    return _walk_forward(s, d)[0]


@add("wf_importances")
def _(s, d):
    return _walk_forward(s, d)[1]


_TESTED = (
    f"lz as (select lab.date, symbol, ret, {r6('(' + '+'.join(f'coalesce(k_{f},0)' for f in FACTORS) + ')/nullif(' + '+'.join(f'cast(k_{f} is not null as integer)' for f in FACTORS) + ',0)', 10)} as score from "
    f"(select date, symbol, ret, {', '.join(f'({rank(f, "date")})/nullif(count({f}) over (partition by date),0) as k_{f}' for f in FACTORS)} from lab) lab "
    "where date in (select date from ix where idx >= 60))"
)


@add("wf_linear_ic", _more(query(f"select n, {sixed('mean', 'hit', 'ir', 't')} from (select {_STATS.format(k='1 as one')} from ic where ic is not null)", "lab"), _FOLD, _TESTED, *_ic_sql("lz", "date", y="ret")))
def _(s, d):
    """The baseline on the months that the folds test."""
    p = sample.labelled(s, d)
    tested = ml.folds(p.select("date")).where("role = 'test'").select("date").distinct()
    base = ml.linear_baseline(p, FACTORS).join(F.broadcast(tested), "date").withColumn("prediction", rounded("prediction", 10))
    return six(stats.series_stats(ml.out_of_sample_ics(p, "ret", {"linear": base}), "ic", []), ["n"], "mean", "hit", "ir", "t")  # a row without months too


@add("wf_ic")
def _(s, d):
    """Out-of-sample ICs of both learners and the baseline, side by side."""
    p = sample.labelled(s, d)
    parts = ml.folds(p.select("date"))
    found = {name: ml.walk_forward(p, FACTORS, "ret", parts, learner=learner)[0] for name, learner in (("first", ml.first_learner()), ("second", ml.second_learner()))}
    return six(ml.out_of_sample_ic(p, "ret", found | {"linear": ml.linear_baseline(p, FACTORS)}), ["learner", "n"], "mean", "hit", "ir", "t")


# ---- beyond the batch surface ------------------------------------------------------------------------------------
@add("sliding_action_windows", "with a as (select cast(user_id as bigint) as symbol, cast(ts as timestamp) as t0, case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as s from events), w as (select symbol, s, cast(date_trunc('day', t0) - to_days(cast(k as integer)) as timestamp) as start from a, (select unnest(range(0, 6)) as k)) select symbol, strftime(start, '%Y-%m-%d') as start, cast(sum(s) as bigint) as net, count(*) as actions from w group by symbol, start")
def _(s, d):
    from ..streaming.actions import sliding_actions

    kind = F.when(F.col("event_type") == "purchase", "upgrade").when(F.col("event_type") == "error", "downgrade").otherwise("maintain")
    e = sample.table(s, d, "events").withColumn("action", kind)
    return sliding_actions(e, "ts", "user_id", "action").select("symbol", F.date_format("start", "yyyy-MM-dd").alias("start"), "net", "actions")


