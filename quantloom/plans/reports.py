"""Assembled panels and report tables: queries that put several operators together, each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rounded
from ..operators import books, point_in_time, signals, stats
from ..operators.time_series import shift
from ..sources import sample
from ..sources.shared import dealt, remove_at_end, shared_dir
from ..sources.store import stored
from .catalog import _FWD, _more, _STATS, add, composite, factor_long, out, six, sixed
from .sql import FACTORS, bucket, query, r6, rank, traded

# ---- point-in-time panels ----------------------------------------------------------------------------------------
_BD = "bd as (select day as date, cast(sum(c) as double)/cast(sum(q) as double)/100 as price from li group by day)"


@add("benchmark_month_return", _more(query(f"select date, {r6('lead(price) over (order by date)/nullif(price,0)-1')} as ret from (select last_day(date) as date, max_by(price, date) as price from bd group by 1)", "li"), _BD))
def _(s, d):
    return six(point_in_time.benchmark_returns(sample.benchmark_daily(s, d)), ["date"], "ret")


def _newest(name: str, left: str, on: str, extra: str = "") -> str:
    """SQL: rows of left with px_<name>, the newest price at most 7 days before `on`."""
    return f"{name} as (select l.*, case when l.{on} - x.date <= 7 then x.price end as px_{name} from {left} l asof left join px x on l.symbol = x.symbol and l.{on} >= x.date{extra})"


_LIVE = (
    "m as (select symbol, date, mcap, f1, f3, mcap*1.25 as ev, case when symbol % 9 <> 0 then last_day(cast(date - interval 3 month as date)) end as period_end from p)",
    _newest("now", "m", "date"), _newest("filing", "(select distinct symbol, period_end from m where period_end is not null)", "period_end"),
    "rf as (select n.symbol, n.date, px_now, px_filing, mcap, f1, f3, ev, coalesce(case when px_filing/nullif(px_now,0) is not null then least(greatest(px_filing/nullif(px_now,0), 0.1), 10) end, 1) as r from now n left join filing g on n.symbol = g.symbol and n.period_end = g.period_end)",
    "rg as (select *, mcap/r as live, mcap/r + (ev-mcap) as live_ev from rf)",
)


@add("live_value_refresh", _more(query(f"select symbol, date, {r6('px_now')} as px_now, {r6('px_filing')} as px_filing, {r6('r')} as price_ratio, {r6('f1*r')} as f1, {r6('live')} as mcap_live, {r6('-ln(live)')} as size, {r6('f3/nullif(ev,0)*(ev/nullif(live_ev,0))')} as ebitda_to_ev from rg", "p", "px"), *_LIVE))
def _(s, d):
    p = sample.panel(s, d).select("symbol", "date", "mcap", "f1", "f3", (F.col("mcap") * 1.25).alias("ev"))
    p = p.withColumn("period_end", F.when(F.col("symbol") % 9 != 0, F.last_day(F.add_months("date", -3))))
    rows = point_in_time.refreshed_prices(p, sample.px_daily(s, d), "period_end")
    rows = point_in_time.refreshed_value(rows, "px_now", "px_filing", "mcap", ["f1"], "ev", "f3")
    return six(rows, ["symbol", "date"], "px_now", "px_filing", "price_ratio", "f1", "mcap_live", "size", "ebitda_to_ev")


_FILED = "fl as (select *, case when (symbol + month(fiscal_date)//3) % 3 <> 0 then fiscal_date + 40 end as accepted from (select symbol, last_day(cast(date_trunc('quarter', day) + interval 2 month as date)) as fiscal_date, cast(sum(d) as double)/count(*) as g1, cast(sum(x) as double)/count(*) as g2 from li group by 1, 2))"
_MASTER = (
    _FILED, "base as (select s.s_suppkey as symbol, g.date from supplier s cross join grid g)", _newest("end_", "base", "date", " and x.price > 0"),
    f"fw as (select symbol, date, price, {_FWD} from (select symbol, date, px_end_ as price from end_) window w as (partition by symbol order by date))",
    "gr as (select symbol, date from base where symbol % 7 <> 0)",
    "ms as (select g.symbol, g.date, fw.price, ret_fwd_1, ret_fwd_3, ret_fwd_6 from gr g left join fw using (symbol, date))",
    "mf as (select ms.*, f.accepted, f.g1, f.g2 from ms asof left join (select * from fl where accepted is not null) f on ms.symbol = f.symbol and ms.date >= f.accepted)",
    "mm as (select mf.*, case when mf.symbol % 5 <> 0 then sector end as sec from mf left join sec using (symbol))",
)


@add("master_assembly", _more(query(f"select symbol, date, accepted, coalesce(sec, 'Unknown') as sector, {sixed('price', 'ret_fwd_1', 'ret_fwd_3', 'ret_fwd_6', 'g1', 'g2')}, cast(date - accepted as integer) as filing_lag_days, price is not null as has_price, accepted is not null as has_fundamentals, coalesce(date - accepted <= 400, false) as fresh_filing, price is not null and accepted is not null and coalesce(date - accepted <= 400, false) as investable from mm", "li", "px", "grid", "sec"), *_MASTER))
def _(s, d):
    dates = sample.grid(sample.lines(s, d))
    members = sample.table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol")).where("symbol % 7 <> 0").crossJoin(F.broadcast(dates))
    m = point_in_time.master(members, sample.px_daily(s, d), sample.filings(s, d), sample.sectors(s, d).where("symbol % 5 <> 0"), dates, "accepted", ["g1", "g2"])
    return six(m, ["symbol", "date", "accepted", "sector", "filing_lag_days", "has_price", "has_fundamentals", "fresh_filing", "investable"], "price", "ret_fwd_1", "ret_fwd_3", "ret_fwd_6", "g1", "g2")


_LOCAL = (
    _FILED, "pf as (select *, coalesce(accepted, fiscal_date + 90) as pit_date from fl where symbol % 6 <> 0 or fiscal_date < date '1994-01-01')",
    "pm as (select symbol, last_day(date) as date, max_by(price, date) as price from px group by 1, 2)",
    "pr as (select *, least(greatest(lead(price, 1) over w/nullif(price,0)-1, -1), 1) as ret_fwd_1, least(greatest(lead(price, 3) over w/nullif(price,0)-1, -1), 2) as ret_fwd_3 from pm window w as (partition by symbol order by date))",
    "pq as (select pr.symbol, pr.date, price, case when lead(price, 1) over w is not null then ret_fwd_1 end as ret_fwd_1, case when lead(price, 3) over w is not null then ret_fwd_3 end as ret_fwd_3 from pr window w as (partition by symbol order by date))",
    "pj as (select q.*, f.pit_date, case when not coalesce(q.date - f.pit_date > 540, false) then g1 end as g1, case when not coalesce(q.date - f.pit_date > 540, false) then g2 end as g2 from pq q asof left join pf f on q.symbol = f.symbol and q.date >= f.pit_date)",
    "ff as (select s_suppkey as symbol, least(greatest(coalesce(case when s_suppkey % 4 <> 0 then (s_suppkey % 13)/cast(10 as double) end, 1), 0.1), 1) as share from supplier)",
    "pk as (select pj.symbol, pj.date, pj.price, ret_fwd_1, ret_fwd_3, pit_date, g1, g2, p.mcap*coalesce(share, 1) as mcap from pj left join p using (symbol, date) left join ff using (symbol))",
    "pt as (select * from (select *, row_number() over (partition by date order by mcap desc, symbol) as place from pk where mcap is not null and price is not null) where place <= 200)",
    "ok as (select date from pt group by date having count(*) filter (ret_fwd_1 is not null and g1 is not null and g2 is not null) >= 50)",
)


@add("local_market_panel", _more(query(f"select symbol, date, pit_date, {sixed('price', 'ret_fwd_1', 'ret_fwd_3', 'g1', 'g2', 'mcap')} from pt where date in (select date from ok)", "li", "px", "p"), *_LOCAL))
def _(s, d):
    f = sample.filings(s, d).where((F.col("symbol") % 6 != 0) | (F.col("fiscal_date") < F.lit("1994-01-01").cast("date")))
    caps = sample.panel(s, d).select("symbol", "date", "mcap")
    m = point_in_time.local_panel(sample.px_daily(s, d), f, caps, sample.free_float(s, d), ["g1", "g2"])
    return six(m, ["symbol", "date", "pit_date"], "price", "ret_fwd_1", "ret_fwd_3", "g1", "g2", "mcap")


# ---- transcripts -------------------------------------------------------------------------------------------------
_AT = lambda m: f"(select t.doc_id, x.price as c{m} from tr t asof left join px x on t.symbol = x.symbol and cast(t.date + interval {m} month as date) >= x.date)"
_TRAN = (
    "tr as (select doc_id, doc_id % 50 + 1 as symbol, date '1993-01-01' + cast(doc_id * 37 % 1800 as integer) as date, cast(n_chars as double) as size, cast(n_chars % 97 as double) as tone from documents)",
    "er as (select tr.*, " + ", ".join(f"c{m}/nullif(c0,0)-1 as ret_fwd_{m}" for m in (1, 3, 6)) + " from tr " + " ".join(f"join {_AT(m)} a{m} using (doc_id)" for m in (0, 1, 3, 6)) + ")",
)


def _events(s: SparkSession, d: str) -> DataFrame:
    return point_in_time.event_returns(sample.transcripts(s, d), sample.px_daily(s, d))


@add("transcript_returns", _more(query(f"select doc_id, symbol, date, {sixed('ret_fwd_1', 'ret_fwd_3', 'ret_fwd_6')} from er", "px"), *_TRAN))
def _(s, d):
    return six(_events(s, d), ["doc_id", "symbol", "date"], "ret_fwd_1", "ret_fwd_3", "ret_fwd_6")


_TIC = (
    "fl as (" + " union all ".join(f"select '{f}' as feature, {m} as horizon, {f} as x, {r6(f'ret_fwd_{m}', 10)} as y from er" for f in ("size", "tone") for m in (1, 3, 6)) + ")", "fc as (select * from fl where x is not null and y is not null)",
    "md as (select feature, horizon, quantile_cont(x, 0.5) as mx from fc group by all)", f"rk as (select feature, horizon, x, y, {rank('x', 'feature, horizon')} as rx, {rank('y', 'feature, horizon')} as ry from fc)",
    "gi as (select feature, horizon, count(*) as n, (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0) as ic, avg(case when (x > mx) = (y > 0) then 1.0::double else 0.0::double end) as hit from rk join md using (feature, horizon) group by all having count(*) >= 30)",
    "gt as (select *, ic*sqrt(n-2)/nullif(sqrt(1-ic*ic),0) as t from gi)",
)


@add("transcript_ic", _more(query(f"select feature, cast(horizon as integer) as horizon, n, {r6('ic*100')} as ic, {r6('hit*100')} as hit, {r6('t')} as t, coalesce(abs(t) >= 2, false) as significant from gt", "px"), *_TRAN, *_TIC))
def _(s, d):
    e = _events(s, d)
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(m).alias("horizon"), F.col(f).alias("x"), rounded(f"ret_fwd_{m}", 10).alias("y")) for f in ("size", "tone") for m in (1, 3, 6)))
    ic = stats.pooled_rank_ic(e.select(F.explode(cells).alias("c")).select("c.*"), "x", "y", ["feature", "horizon"])
    ic = ic.withColumns({"ic": F.col("ic") * 100, "hit": F.col("hit") * 100, "significant": F.coalesce(F.abs("t") >= 2, F.lit(False))})
    return six(ic, ["feature", "horizon", "n", "significant"], "ic", "hit", "t")


# ---- fractile reports and the factor summary ---------------------------------------------------------------------
_REPORT = ("total", "active", "te", "ir", "t", "success", "vol", "sharpe", "beta", "alpha", "turnover")


def _report(source: str, n: int, cw: bool) -> tuple[str, ...]:
    """SQL of the report on source (factor, date, symbol, bucket, ret, mcap): ends in rp."""
    q, mean = "Q" if n == 5 else "D", "sum(ret*mcap)/nullif(sum(mcap),0)" if cw else "avg(ret)"
    ann = lambda x: f"case when product(1+{x}) > 0 then pow(product(1+{x}), 12.0::double/count({x}))-1 end"
    return (
        f"fr as (select factor, date, {n}-bucket as k, {mean} as r from {source} group by factor, date, bucket)", f"mk as (select factor, date, {mean} as m from {source} group by factor, date)",
        f"se as (select factor, '{q}' || cast(k as integer) as line, date, r, m, r-m as a from fr join mk using (factor, date) union all select factor, '{q}1-{q}{n}', date, max(r) filter (k = 1) - max(r) filter (k = {n}) as x, null, x from fr group by factor, date union all select factor, 'Market', date, m, null, m from mk)",
        f"ma as (select factor, {ann('m')} as whole, count(*) as months from mk where m is not null group by factor)",
        f"s0 as (select factor, line, count(*) as n, {ann('r')} as total, stddev_samp(a)*sqrt(12) as te, avg(a)/nullif(stddev_samp(a),0)*sqrt(12) as ir, avg(case when a > 0 then 1.0::double else 0.0::double end) as success, stddev_samp(r)*sqrt(12) as vol, avg(r)/nullif(stddev_samp(r),0)*sqrt(12) as sharpe, case when count(m) >= 12 then covar_samp(r, m)/nullif(var_pop(m),0) end as beta, avg(r) as ar, avg(m) as am from se where r is not null group by factor, line)",
        f"tw as (select factor || ':' || '{q}' || cast({n}-bucket as integer) as fid, date, symbol, 1.0::double/count(*) over (partition by factor, date, bucket) as w from {source})", "tx as (" + traded("tw", "fid") + ")",
        "ty as (select fid, avg(traded)/2 as turnover from (select fid, traded, row_number() over (partition by fid order by date) as k from tx) where k > 1 group by fid)",
        "rp as (select s0.factor, line, n, total, case when line = 'Market' then 0 when contains(line, '-') then total else total-whole end as active, te, ir, ir*sqrt(months/12.0::double) as t, success, vol, sharpe, beta, (ar-beta*am)*12 as alpha, turnover from s0 join ma using (factor) left join ty on fid = s0.factor || ':' || line)",
    )


for _n, _cw in ((5, False), (10, True)):

    @add(f"fractile_report_{'q5_ew' if _n == 5 else 'd10_cw'}", _more(query(f"select line, n, {sixed(*_REPORT)} from rp", f"b{_n}"), f"bs as (select 'score' as factor, date, symbol, bucket, ret, mcap from b{_n} where bucket is not null)", *_report("bs", _n, _cw)))
    def _(s, d, n=_n, cw=_cw):
        rows = composite(s, d).withColumn("factor", F.lit("score"))
        return six(books.fractile_report(rows, "score", "ret", "mcap", n, cw, ["factor"]).withColumnRenamed("row", "line"), ["line", "n"], *_REPORT)


_IC2 = f"(select factor, date, {rank('value', 'factor, date')} as rx, {rank('r2', 'factor, date')} as ry from (select *, lead(ret) over (partition by factor, symbol order by date) as r2 from long) where value is not null and r2 is not null)"
_SUM = ("ic_mean", "ic_t", "ic_hit", "ic2_mean", "ic2_t", "q1_active", "q1_ir", "spread_pa", "spread_ir", "q1_turnover", "pure_pa", "pure_ir", "pure_t", "raw_pa", "raw_ir", "raw_t")
# Controls: log cap and book-to-price (f2); a control is left out where the factor is that control.
_FZ = ", ".join(f"coalesce(({x}-avg({x}) over w)/nullif(stddev_pop({x}) over w,0),0) as {x}" for x in ("value", "lm", "bp"))
_PURE = (
    f"fz as (select date, sector, factor, ret, {_FZ} from (select l.*, ln(greatest(l.mcap, 1)) as lm, case when l.factor = 'f2' then 0.0::double else lab.f2 end as bp, sector "
    "from long l join lab using (date, symbol) join sec using (symbol) where l.ret is not null and l.value is not null and l.mcap is not null and lab.f2 is not null) "
    "window w as (partition by factor, date))"
)
_D3 = "a00*(a11*a22-a12*a12)-a01*(a01*a22-a12*a02)+a02*(a01*a12-a11*a02)"
_SUMMARY = (
    "i1 as (select * from (select " + _STATS.format(k="factor") + " from ics where ic is not null group by factor))",
    f"c2 as (select factor, date, (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0) as ic from {_IC2} group by factor, date having count(*) >= 20)",
    "i2 as (select * from (select " + _STATS.format(k="factor") + " from c2 where ic is not null group by factor))",
    f"bs as (select * from (select factor, date, symbol, {bucket('value', 'factor, date', 5)} as bucket, ret, mcap from long where value is not null and ret is not null and mcap is not null) where bucket is not null)",
    _PURE,
    "fd as (select factor, date, ret-avg(ret) over w as y, value-avg(value) over w as x0, lm-avg(lm) over w as x1, bp-avg(bp) over w as x2 from fz window w as (partition by factor, date, sector))",
    "fs as (select factor, date, sum(x0*x0) as a00, sum(x0*x1) as a01, sum(x0*x2) as a02, sum(x1*x1) as a11, sum(x1*x2) as a12, sum(x2*x2) as a22, "
    "sum(x0*y) as b0, sum(x1*y) as b1, sum(x2*y) as b2 from fd group by factor, date having count(*) >= 30)",
    f"pu as (select factor, date, case when factor = 'f2' then (b0*a11-a01*b1)/nullif(a00*a11-a01*a01,0) "
    f"else (b0*(a11*a22-a12*a12)-a01*(b1*a22-a12*b2)+a02*(b1*a12-a11*b2))/nullif({_D3},0) end as r from fs)",
    "ra as (select factor, date, regr_slope(ret, value) as r from fz group by factor, date having count(*) >= 30)",
    *(f"{k}s as (select factor, avg(r)*12 as pa, avg(r)/nullif(stddev_samp(r),0)*sqrt(12) as ir, avg(r)/nullif(stddev_samp(r),0)*sqrt(count(*)) as t from {k} where r is not null group by factor)" for k in ("pu", "ra")),
)
_JOIN = (
    "sy as (select i1.factor, i1.mean as ic_mean, i1.t as ic_t, i1.hit as ic_hit, i2.mean as ic2_mean, i2.t as ic2_t, q.active as q1_active, q.ir as q1_ir, x.total as spread_pa, x.ir as spread_ir, q.turnover as q1_turnover, pus.pa as pure_pa, pus.ir as pure_ir, pus.t as pure_t, ras.pa as raw_pa, ras.ir as raw_ir, ras.t as raw_t from i1 left join i2 using (factor) left join (select * from rp where line = 'Q1') q using (factor) left join (select * from rp where line = 'Q1-Q5') x using (factor) left join pus using (factor) left join ras using (factor))",
)
_MAXT = "greatest(abs(ic_t), abs(ic2_t), abs(pure_t))"


def _built_summary(s: SparkSession, d: str) -> DataFrame:
    return summarised(sample.labelled(s, d).join(sample.sectors(s, d), "symbol", "left"), FACTORS)


def summarised(panel: DataFrame, factors: list[str]) -> DataFrame:
    """A row a factor of panel (date, symbol, ret, mcap, sector and the factors, f2 among them). A name's row of a factor
    travels in an array to its cross-section by factor and date: since no reader narrows or filters an array, ICs, fractiles,
    turnover and cross-sectional regressions all read one exchange."""
    panel = panel.withColumn("r2", shift("ret", -1, ["symbol"])).withColumn("bp", F.col("f2"))
    row = lambda f: F.array(F.struct("symbol", "sector", "ret", "mcap", "r2", "bp", F.col(f).alias("value"))).alias("__row")
    cells = panel.select("date", F.inline(F.array(*(F.struct(F.lit(f).alias("factor"), row(f)) for f in factors))))
    long = dealt(cells, "factor", "date").select("factor", "date", F.inline("__row"))
    ics = stats.series_stats(stats.rank_ics(long, "value", ["ret", "r2"], ["factor", "date"]), "ic", ["factor", "ret"])
    of = lambda c, r: F.max(F.when(F.col("ret") == r, F.col(c)))
    ics = ics.groupBy("factor").agg(
        *(of(c, "ret").alias(f"ic_{c}") for c in ("mean", "t", "hit")), *(of(c, "r2").alias(f"ic2_{c}") for c in ("mean", "t")), F.max(F.col("ret") == "ret").alias("__found")
    ).where("__found").drop("__found")
    report = books.fractile_report(long, "value", "ret", "mcap", 5, False, ["factor"]).where("row in ('Q1', 'Q1-Q5')")
    top = lambda c, row: F.max(F.when(F.col("row") == row, F.col(c)))
    legs = report.groupBy("factor").agg(
        top("active", "Q1").alias("q1_active"), top("ir", "Q1").alias("q1_ir"), top("turnover", "Q1").alias("q1_turnover"), top("total", "Q1-Q5").alias("spread_pa"), top("ir", "Q1-Q5").alias("spread_ir")
    )
    # A control is left out where the factor is that control: it is then all zeros.
    rows = long.where("bp is not null").withColumn("bp", F.when(F.col("factor") != "f2", F.col("bp")).otherwise(0.0)).withColumn("lm", F.ln(F.greatest("mcap", F.lit(1.0))))
    fm = stats.pure_and_raw_returns(rows, "ret", "value", ["lm", "bp"], ["factor", "date"], "sector")
    both = fm.unpivot(["factor"], ["pure", "raw"], "kind", "r")
    each = stats.series_stats(both, "r", ["factor", "kind"]).withColumns({"pa": F.col("mean") * 12, "ir": F.col("ir") * F.sqrt(F.lit(12.0))})
    kind = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}")
    returns = each.groupBy("factor").agg(*(kind(c, k) for k in ("pure", "raw") for c in ("pa", "ir", "t")))
    return ics.join(legs, "factor", "left").join(returns, "factor", "left")


def _summary(s: SparkSession, d: str) -> DataFrame:
    """A row a factor, all factors in one long plan. It is stored for the state of its inputs, so that the queries that read
    it build it once."""
    path = f"{shared_dir(s)}/factor-summary-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
    inputs = [sample.table(s, d, t) for t in ("lineitem", "supplier", "nation", "region")]
    found = stored(s, path, lambda: _built_summary(s, d), inputs, ["factor"], [], 1)
    remove_at_end(s, path)
    return found


@add("factor_summary", _more(query(f"select factor, {sixed(*_SUM)} from sy", "ics", "long", "sec"), *_SUMMARY, *_report("bs", 5, False), *_JOIN))
def _(s, d):
    return six(_summary(s, d), ["factor"], *_SUM)


@add("significant_factors", _more(query(f"select factor, {r6(_MAXT)} as max_t, {r6(_MAXT)} >= 2 as strict, cast(row_number() over (order by {r6(_MAXT)} desc, factor) as integer) as place from sy where {r6(_MAXT)} >= 1.5", "ics", "long", "sec"), *_SUMMARY, *_report("bs", 5, False), *_JOIN))
def _(s, d):
    most = rounded(F.greatest(F.abs("ic_t"), F.abs("ic2_t"), F.abs("pure_t")))
    rows = _summary(s, d).withColumn("max_t", most).where("max_t >= 1.5")
    place = F.row_number().over(Window.orderBy(F.desc("max_t"), "factor"))  # a row a factor
    return rows.select("factor", "max_t", (F.col("max_t") >= 2).alias("strict"), place.alias("place"))


@add("screen_selection", _more(query(f"select factor, {sixed('ic_t', 'ic2_t', 'q1_ir')}, coalesce({r6('ic_t')} >= 1.5, false) or coalesce({r6('ic2_t')} >= 1.5, false) or coalesce({r6('q1_ir')} >= 0.3, false) as selected from sy", "ics", "long", "sec"), *_SUMMARY, *_report("bs", 5, False), *_JOIN))
def _(s, d):
    over = lambda c, least: F.coalesce(rounded(c) >= least, F.lit(False))
    return six(_summary(s, d).withColumn("selected", over("ic_t", 1.5) | over("ic2_t", 1.5) | over("q1_ir", 0.3)), ["factor", "selected"], "ic_t", "ic2_t", "q1_ir")


# ---- predicates on names -----------------------------------------------------------------------------------------
@add("ordinary_tickers", "select s_suppkey, base from (select s_suppkey, replace(s_name, 'Supplier#', '') || '.AX' as s, replace(case when s_suppkey % 3 = 0 then substr('ABCDEFGH', 1, cast(s_suppkey % 7 as integer)) else s_name end || '.AX', '.AX', '') as base from supplier) where regexp_full_match(base, '[A-Za-z]{2,4}')")
def _(s, d):
    from ..operators.text import ordinary_ticker, stripped_suffix

    name = F.when(F.col("s_suppkey") % 3 == 0, F.substring(F.lit("ABCDEFGH"), F.lit(1), (F.col("s_suppkey") % 7).cast("int"))).otherwise(F.col("s_name"))
    rows = sample.table(s, d, "supplier").select("s_suppkey", F.concat(name, F.lit(".AX")).alias("symbol"))
    return rows.where(ordinary_ticker("symbol", ".AX")).select("s_suppkey", stripped_suffix("symbol", ".AX").alias("base"))


@add("vendor_tickers", "select s_suppkey, replace(replace(s_name, '#', '.'), '.', '-') as ticker from supplier")
def _(s, d):
    from ..operators.text import vendor_ticker

    return sample.table(s, d, "supplier").withColumn("t", F.replace("s_name", F.lit("#"), F.lit("."))).select("s_suppkey", vendor_ticker("t").alias("ticker"))


# ---- fetched parts, semi-joins, corpus index, lexicon as a table -------------------------------------------------
@add("bulk_fetch", "select symbol, date, cents from (select o_custkey as symbol, case when o_orderkey % 97 <> 0 then cast(o_orderdate as date) end as date, cast(round(o_totalprice*100) as bigint) as cents from orders where o_orderstatus in ('O', 'F', 'P')) where date is not null")
def _(s, d):
    from pyspark.sql import types as T

    from ..sources import bulk

    o = sample.table(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 97 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a")
    part = lambda st: o.where(F.col("o_orderstatus") == st).select(F.col("o_custkey").alias("symbol"), text.alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    schema = T.StructType([T.StructField("symbol", T.LongType()), T.StructField("date", T.StringType()), T.StructField("cents", T.LongType())])
    return bulk([part("O"), part("F"), part("P")], schema, ["date"], ["symbol", "date"])


@add("covered_names", query("select symbol, date from p where symbol in (select s_suppkey from supplier where s_acctbal > 0)", "p"))
def _(s, d):
    held = sample.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    return sample.panel(s, d).select("symbol", "date").join(held, "symbol", "left_semi")


@add("transcript_index", "with tr as (select doc_id % 50 + 1 as symbol, date '1993-01-01' + cast(doc_id * 37 % 1800 as integer) as date, n_chars from documents) select symbol, cast(year(date) as integer) as year, cast(quarter(date) as integer) as quarter, count(*) as documents, cast(sum(n_chars) as bigint) as chars, max(date) as last from tr group by all")
def _(s, d):
    t = sample.transcripts(s, d)
    return t.groupBy("symbol", F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(F.count("*").alias("documents"), F.sum("size").cast("long").alias("chars"), F.max("date").alias("last"))


_CATS = ["positive", "negative", "uncertain", "litigious", "constraining", "modal"]
_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')"


@add("doc_sentiment_table", f"with lx as (select distinct word, length(word) % 6 as c from (select unnest({_WORDS}) as word from benchmark)), t as (select doc_id, {_WORDS} as w from documents), h as (select doc_id, " + ", ".join(f"count(*) filter (c = {i}) as h{i}" for i in range(6)) + f" from (select doc_id, unnest(w) as word from t) join lx using (word) group by doc_id), s as (select t.doc_id, cast(len(w) as bigint) as word_count, " + ", ".join(f"coalesce(cast(h{i} as double)*100/nullif(len(w),0),0) as {c}" for i, c in enumerate(_CATS)) + f" from t left join h on h.doc_id = t.doc_id) select doc_id, word_count, {sixed(*_CATS)}, {r6('positive-negative')} as net from s")
def _(s, d):
    from ..operators import text

    words = sample.table(s, d, "benchmark").select(F.explode(text.tokens("text")).alias("word")).distinct()
    lexicon = words.withColumn("category", F.get(F.array(*map(F.lit, _CATS)), F.length("word") % 6))
    return six(text.sentiment_by_table(sample.table(s, d, "documents"), "doc_id", "text", lexicon, _CATS, "positive", "negative"), ["doc_id", "word_count"], *_CATS, "net")
