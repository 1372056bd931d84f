"""DuckDB text shared by the oracle queries: common table expressions that depend on one another."""

from __future__ import annotations


def r6(x: str, d: int = 6) -> str:
    return f"floor(({x})*cast({10**d} as double)+cast(0.5 as double))/cast({10**d} as double)"


def rank(x: str, keys: str) -> str:
    return f"case when {x} is not null then rank() over (partition by {keys} order by {x} asc nulls last) + cast(count(*) over (partition by {keys}, {x}) - 1 as double)/cast(2 as double) end"


def bucket(x: str, keys: str, n: int, tie: str = "symbol") -> str:
    r = f"cast(row_number() over (partition by {keys} order by {x} asc nulls last, {tie}) as bigint)"
    size = f"count({x}) over (partition by {keys})"
    return f"case when {x} is not null and {size} >= {n} then cast(greatest(floor(cast(({r}-1)*{n}+({size}-1)-1 as double)/greatest({size}-1,1))-1,0) as integer) end"


FACTORS = ["f1", "f2", "f3", "f4", "f5"]
_Z = "".join(f", ({f}-avg({f}) over w)/nullif(stddev_samp({f}) over w,0) as z_{f}" for f in FACTORS)
_MEAN = "(" + "+".join(f"coalesce(z_{f},0)" for f in FACTORS) + ")/nullif(" + "+".join(f"cast(z_{f} is not null as integer)" for f in FACTORS) + ",0)"

CTES: dict[str, tuple[str, list[str]]] = {
    "li": ("select l_suppkey as symbol, cast(l_shipdate as date) as day, last_day(cast(l_shipdate as date)) as date, cast(round(l_extendedprice*100) as bigint) as c, cast(l_quantity as bigint) as q, cast(round(l_discount*100) as bigint) as d, cast(round(l_tax*100) as bigint) as x, cast(l_returnflag='R' as bigint) as r from lineitem", []),
    "px": ("select symbol, day as date, cast(sum(c) as double)/cast(sum(q) as double)/100 as price, cast(sum(q) as bigint) as volume from li group by symbol, day", ["li"]),
    "p0": ("select symbol, date, cast(sum(c) as double)/cast(sum(q) as double)/100 as price, cast(sum(c) as double)/100 as mcap, cast(sum(d) as double)/count(*) as f1, cast(sum(x) as double)/count(*) as f2, cast(sum(q) as double)/count(*) as f3, cast(sum(r) as double)/count(*) as f5 from li group by symbol, date", ["li"]),
    "p": ("select *, mcap/nullif(lag(mcap) over (partition by symbol order by date),0)-1 as f4 from p0", ["p0"]),
    "lab": ("select *, lead(price) over (partition by symbol order by date)/nullif(price,0)-1 as ret from p", ["p"]),
    "grid": ("select last_day(cast(unnest(generate_series(date_trunc('month', (select min(date) from li)), date_trunc('month', (select max(date) from li)), interval 1 month)) as date)) as date", ["li"]),
    "bal": ("select s.symbol, g.date, p.price from (select distinct symbol from p) s cross join grid g left join p on p.symbol = s.symbol and p.date = g.date", ["p", "grid"]),
    "sec": ("select s_suppkey as symbol, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey", []),
    "zed": (f"select *{_Z} from lab window w as (partition by date)", ["lab"]),
    "comp": (f"select *, {r6(_MEAN, 8)} as score from zed", ["zed"]),
    "b5": (f"select *, {bucket('score', 'date', 5)} as bucket from comp where score is not null and ret is not null and mcap is not null", ["comp"]),
    "b10": (f"select *, {bucket('score', 'date', 10)} as bucket from comp where score is not null and ret is not null and mcap is not null", ["comp"]),
    "long": (" union all ".join(f"select date, symbol, '{f}' as factor, {f} as value, ret, mcap from lab" for f in FACTORS), ["lab"]),
    "icr": (f"select factor, date, {rank('value', 'factor, date')} as rx, {rank('ret', 'factor, date')} as ry from long where value is not null and ret is not null", ["long"]),
    "ics": ("select factor, date, count(*) as n, (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0) as ic from icr group by factor, date having count(*) >= 20", ["icr"]),
    "mkt": ("select date, sum(ret*mcap)/nullif(sum(mcap),0) as ret from lab where ret is not null group by date", ["lab"]),
    "ls": ("select *, case when bucket = 0 then 'bot' else 'top' end as side from b5 where bucket in (0, 4)", ["b5"]),
    "lsw": ("select date, side, symbol, ret, 1.0::double/count(*) over (partition by date, side) as w from ls", ["ls"]),
    "lst": ("select side, date, traded from (" + "{traded_lsw}" + ")", ["lsw"]),
    "legs": ("select g.date, max(case when g.side='top' then leg end) as long_leg, max(case when g.side='bot' then leg end) as short_leg, max(case when g.side='top' then traded end) as top_traded, max(case when g.side='bot' then traded end) as bot_traded from (select date, side, sum(w*ret) as leg from lsw group by date, side) g join lst t on g.date = t.date and g.side = t.side group by g.date", ["lsw", "lst"]),
    "book": ("select date, long_leg, short_leg, long_leg-short_leg as gross, top_traded, bot_traded, top_traded+bot_traded as traded from legs", ["legs"]),
    "qw": ("select date, symbol, ret, mcap/nullif(sum(mcap) over (partition by date),0) as w from b5 where bucket = 4", ["b5"]),
    "dw": ("select date, symbol, ret, 1.0::double/count(*) over (partition by date) as w from b10 where bucket = 9", ["b10"]),
}


def traded(frame: str, keys: str = "") -> str:
    """Sum of absolute weight changes between consecutive holding dates."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    same = f"a.{keys} = b.{keys} and " if keys else ""
    return (
        f"select coalesce(a.date, b.date) as date, {f'coalesce(a.{keys}, b.{keys}) as {keys}, ' if keys else ''}sum(abs(coalesce(a.w,0)-coalesce(b.w,0))) as traded from "
        f"(select f.*, k from {frame} f join (select {k}date, row_number() over ({part}order by date) as k from (select distinct {k}date from {frame})) d using ({k}date)) a full join "
        f"(select {k}symbol, w, k + 1 as k, lead_date as date from (select f.*, k, lead_date from {frame} f join (select {k}date, row_number() over ({part}order by date) as k, lead(date) over ({part}order by date) as lead_date from (select distinct {k}date from {frame})) d using ({k}date)) where lead_date is not null) b "
        f"on {same}a.symbol = b.symbol and a.k = b.k group by 1{', 2' if keys else ''}"
    )


CTES["lst"] = (CTES["lst"][0].replace("{traded_lsw}", traded("lsw", "side")), ["lsw"])
CTES["qt"] = (traded("qw"), ["qw"])
CTES["dt"] = (traded("dw"), ["dw"])
CTES["qbook"] = ("select g.date, gross, names, traded from (select date, sum(w*ret) as gross, count(*) as names from qw group by date) g join qt using (date)", ["qw", "qt"])
CTES["dbook"] = ("select g.date, gross, names, traded from (select date, sum(w*ret) as gross, count(*) as names from dw group by date) g join dt using (date)", ["dw", "dt"])
CTES["ser"] = ("select 'top_quintile_cw' as series, date, gross, traded from qbook union all select 'top_decile_ew', date, gross, traded from dbook union all select 'ls_quintile_ew', date, gross, traded from book", ["qbook", "dbook", "book"])
CTES["net"] = ("select series, date, gross, traded, cost as cost_bps, gross-traded*cost/cast(10000 as double) as net from ser, (select unnest([0.0::double, 5, 10, 25, 50]) as cost)", ["ser"])


def query(body: str, *need: str) -> str:
    """body with the expressions it needs, each after those it depends on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in CTES[name][1]:
            visit(d)
        if name not in order:
            order.append(name)

    for n in need:
        visit(n)
    return ("with " + ",\n".join(f"{n} as materialized ({CTES[n][0]})" for n in order) + "\n" if order else "") + body
