"""Hand-checkable fixtures for the panel operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom import plans
from quantloom.functions import clip, ratio, rounded, row_mean, row_weighted_mean
from quantloom.operators import asof, books, cross_section, membership, metrics, ml, point_in_time, signals, stats, text, time_series
from quantloom.sources import cache_key, dedup_prices, io, month_ends, parse_cached, quarter_ends, read_present, sample

D = dt.date.fromisoformat


def month(k, year=2010):
    first = dt.date(year + (k + 1) // 12, (k + 1) % 12 + 1, 1)
    return first - dt.timedelta(days=1)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_membership(spark):
    today = spark.createDataFrame([("P",), ("Q",)], "symbol string")
    log = [("2020-01-10", "P", "R"), ("2020-02-10", "S", ""), ("2020-03-10", "", "S"), ("2020-02-10", " ", ""), ("2020-04-10", "Q", "Q")]
    changes = spark.createDataFrame([(D(d), a, r) for d, a, r in log], "date date, added string, removed string")
    days = ["2020-01-09", "2020-01-10", "2020-02-10", "2020-03-09", "2020-03-10", "2020-04-09", "2020-04-10"]
    got = membership.membership_asof(today, changes, spark.createDataFrame([(D(d),) for d in days], "date date")).collect()
    by = {d: {r.symbol for r in got if r.date == D(d)} for d in days}
    assert by == {"2020-01-09": {"Q", "R"}, "2020-01-10": {"P", "Q"}, "2020-02-10": {"P", "Q", "S"}, "2020-03-09": {"P", "Q", "S"}, "2020-03-10": {"P", "Q"}, "2020-04-09": {"P", "Q"}, "2020-04-10": {"P", "Q"}}


def test_asof(spark):
    left = spark.createDataFrame([("a", D(f"2020-01-{d:02d}"), i) for i, d in enumerate([1, 5, 10, 18, 20])] + [("b", D("2020-01-05"), 9)], "k string, t date, i int")
    right = spark.createDataFrame([("a", D("2020-01-05"), 1, 10), ("a", D("2020-01-10"), 2, 20), ("a", D("2020-01-19"), 3, None), ("a", None, 4, 4)], "k string, rt date, v int, w int")
    got = {(r.k, r.i): (r.rt, r.v, r.w) for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v", "w"]).collect()}
    assert got[("a", 0)] == (None, None, None) and got[("a", 1)] == (D("2020-01-05"), 1, 10) and got[("a", 3)][1] == 2
    assert got[("a", 4)] == (D("2020-01-19"), 3, None) and got[("b", 9)] == (None, None, None)
    near = {(r.k, r.i): r.v for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"], within_days=7).collect()}
    assert near[("a", 3)] is None and near[("a", 2)] == 2


def test_filing_accepted_on_the_day_is_seen_the_next(spark):
    left = spark.createDataFrame([("a", D("2020-01-31")), ("a", D("2020-02-29"))], "symbol string, date date")
    right = spark.createDataFrame([("a", dt.datetime(2020, 1, 31, 16), 5.0)], "symbol string, accepted timestamp, v double")
    j = asof.asof_join(left, right, ["symbol"], "date", "accepted", ["v"])
    assert column(j, "v", "date") == [None, 5.0]
    flags = point_in_time.investable_flags(j.withColumn("price", F.lit(1.0)), "price", "accepted")
    assert column(flags, "investable", "date") == [False, True]


def test_equal_times_take_the_last_by_tie(spark):
    left = spark.createDataFrame([("a", D("2020-01-31"))], "k string, t date")
    right = spark.createDataFrame([("a", D("2020-01-05"), 1), ("a", D("2020-01-05"), 2)], "k string, rt date, v int")
    assert asof.asof_join(left, right, ["k"], "t", "rt", ["v"], tie=["v"]).collect()[0].v == 2


def test_ranks(spark):
    df = spark.createDataFrame([("d", s, v) for s, v in zip("abcde", [1.0, 2.0, 2.0, 3.0, None], strict=True)], "date string, symbol string, v double")
    got = df.select("symbol", cross_section.avg_rank("v", ["date"]).alias("r"), cross_section.pct_rank("v", ["date"]).alias("p"), cross_section.first_rank("v", ["date"], "symbol").alias("f"))
    assert column(got, "r", "symbol") == [1.0, 2.5, 2.5, 4.0, None]
    assert column(got, "p", "symbol") == [0.25, 0.625, 0.625, 1.0, None]
    assert column(got, "f", "symbol") == [1, 2, 3, 4, None]


@pytest.mark.parametrize("size,n", [(12, 10), (7, 5), (91, 10), (20, 5), (4, 5)])
def test_bucket(spark, size, n):
    df = spark.createDataFrame([("d", i, float(i)) for i in range(size)], "date string, symbol int, v double")
    got = column(df.select("symbol", cross_section.bucket("v", ["date"], "symbol", n).alias("b")), "b", "symbol")
    want = [max(-(-(r * n) // (size - 1)) - 1, 0) for r in range(size)] if size >= n else [None] * size
    assert got == want
    if (size, n) == (12, 10):
        assert [got.count(k) for k in range(10)] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 2]


def test_winsorise_and_zero_spread(spark):
    df = spark.createDataFrame([("d", i, float(i)) for i in range(1, 101)] + [("d", 101, 1e6), ("d", 102, None)], "date string, symbol int, v double")
    got = cross_section.winsorise(df, "v", ["date"])
    hi = 100 + 0.0 * 1e6
    assert column(got, "v", "symbol")[100] == pytest.approx(hi) and column(got, "v", "symbol")[101] is None and column(got, "v", "symbol")[0] == 2.0
    flat = spark.createDataFrame([("d", i, 5.0) for i in range(3)], "date string, symbol int, v double")
    assert column(flat.select("symbol", cross_section.zscore("v", ["date"]).alias("z")), "z", "symbol") == [None] * 3


def test_ic_needs_names_and_spread(spark):
    rows = [("a", i, float(i), float(i)) for i in range(20)] + [("b", i, float(i), 1.0) for i in range(19)] + [("c", i, 1.0, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "date string, symbol int, s double, r double")
    got = {r.date: r.ic for r in stats.rank_ic(df, "s", "r", ["date"]).collect()}
    assert got == {"a": 1.0, "c": None}
    s = stats.series_stats(stats.rank_ic(df, "s", "r", ["date"]), "ic", []).collect()[0]
    assert s.n == 1 and s["mean"] == 1.0 and s.ir is None


def test_rolling_and_shift(spark):
    rets = [0.1, None, 0.2, 0.0, None, 0.3, 0.1, 0.05, None, 0.2, 0.1, 0.0, 0.1, 0.2]
    df = spark.createDataFrame([("a", month(i), r) for i, r in enumerate(rets)], "symbol string, date date, r double")
    vol = column(df.select("date", time_series.rolling_vol("r", ["symbol"]).alias("v")), "v", "date")
    assert vol[:7] == [None] * 7 and vol[7] is not None
    px = spark.createDataFrame([("a", month(0), 1.0), ("a", month(2), 4.0), ("b", month(1), 1.0)], "symbol string, date date, price double")
    loose = column(px.where("symbol = 'a'").select("date", time_series.forward_return("price", 1, ["symbol"]).alias("f")), "f", "date")
    assert loose == [3.0, None]
    grid = spark.createDataFrame([(month(i),) for i in range(3)], "date date")
    strict = point_in_time.with_forward_returns(time_series.balanced(px, grid)).where("symbol = 'a'")
    assert column(strict, "ret_fwd_1", "date") == [None, None, None] and strict.count() == 3


def test_drawdown_starts_at_the_first_value(spark):
    df = spark.createDataFrame([("s", month(i), r) for i, r in enumerate([-0.10, 0.05, -0.20])], "series string, date date, ret double")
    assert column(time_series.with_drawdown(df, "ret", ["series"]), "drawdown", "date") == pytest.approx([0.0, 0.0, -0.2])
    p = metrics.performance(df, "ret", ["series"]).collect()[0]
    assert p.total == pytest.approx(0.9 * 1.05 * 0.8 - 1) and p.max_drawdown == pytest.approx(-0.2) and p.hit == pytest.approx(1 / 3)
    lost = metrics.performance(spark.createDataFrame([("s", month(0), -1.5)], "series string, date date, ret double"), "ret", ["series"]).collect()[0]
    assert lost.cagr is None


def test_traded(spark):
    rows = [(0, "a", 0.5), (0, "b", 0.5), (2, "a", 1.0), (3, "c", 1.0)]
    df = spark.createDataFrame([(month(d), s, w) for d, s, w in rows], "date date, symbol string, w double")
    assert column(books.traded(df), "traded", "date") == pytest.approx([1.0, 1.0, 2.0])
    t = metrics.turnover(books.traded(df).withColumn("series", F.lit("x")), ["series"]).collect()[0]
    assert t.turnover_pa == pytest.approx(1.5 / 2 * 12)
    net = metrics.net_returns(books.traded(df).withColumn("gross", F.lit(0.01)), [10.0])
    assert column(net, "net", "date")[2] == pytest.approx(0.01 - 0.002)


def test_capm(spark):
    df = spark.createDataFrame([("s", i, 0.002 + 1.3 * (x := 0.01 * i - 0.05), x) for i in range(12)], "series string, i int, y double, x double")
    got = stats.capm(df, "y", "x", ["series"]).collect()[0]
    assert got.beta == pytest.approx(1.3) and got.alpha == pytest.approx(0.024)
    assert stats.capm(df.where("i < 11"), "y", "x", ["series"]).collect()[0].beta is None
    assert df.agg(stats.biased_beta("y", "x").alias("b")).collect()[0].b == pytest.approx(1.3 * 12 / 11)


def test_pure_factor_recovers_coefficients(spark):
    rows = [(d, i, "xyz"[i % 3], math.sin(i * 1.7), math.cos(i * 0.9), math.sin(i * 0.3 + 1)) for d in ("d", "e") for i in range(40)]
    df = spark.createDataFrame(rows, "date string, i int, sector string, a double, b double, c double")
    df = df.withColumn("y", 2 * F.col("a") - F.col("b") + 0.5 * F.col("c") + F.when(F.col("sector") == "x", 3.0).otherwise(1.0)).withColumn("b", F.when(F.col("date") == "e", F.col("a")).otherwise(F.col("b")))
    got = {r.date: r.coef for r in stats.demeaned_slope(df, "y", ["a", "b", "c"], ["date"], "sector").collect()}
    alone = {r.date: r.coef for r in stats.demeaned_slope(df, "y", ["a", "c"], ["date"], "sector").collect()}
    assert got["d"] == pytest.approx(2.0) and got["e"] == pytest.approx(alone["e"] / 2)  # b is a: the two share its coefficient


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8])
def test_least_squares_equal_lstsq_of_any_rank(spark, m):
    import numpy as np

    from quantloom.operators import least_squares

    rng = np.random.default_rng(m)
    names, rows, want = [f"x{i}" for i in range(m)], [], {}
    for date in range(12):
        n = 40
        x = rng.normal(size=(n, m)) * 10.0 ** rng.integers(-3, 4, m)
        sector = rng.choice(["a", "b", "c", "d"][: date % 4 + 1], n)
        if date % 3 == 1:
            x[:, 0] = 0.0  # the z-score of a constant
        if date % 3 == 2 and m > 1:
            x[:, -1] = 2 * x[:, 0] - 1
        if date % 4 == 3 and m > 2:
            x[:, 1] = sector == "b"
        y = x @ rng.normal(size=m) + rng.normal(size=n)
        rows += [(date, *map(float, v), str(s), float(t)) for v, s, t in zip(x, sector, y, strict=True)]
        present = sorted(set(sector))
        full = np.column_stack([np.ones(n), x, *(sector == s for s in present[1:])]).astype(float)
        want[date] = [(np.linalg.lstsq(d, y, rcond=1e-8 if date % 4 == 3 else None)[0][1 : k + 1], np.linalg.matrix_rank(d / np.maximum(np.linalg.norm(d, axis=0), 1e-300), 1e-8)) for d, k in ((full, m), (full[:, :2], 1))]
    rows += [(50, *[1.0] * m, "a", 1.0)] * 29 + [(51, *[1.0] * m, None, 1.0)] * 40 + [(52, *[None] * m, "a", 1.0)] * 40
    df = spark.createDataFrame(rows, f"date long, {', '.join(f'{c} double' for c in names)}, sector string, y double").repartition(3)
    got = {r.date: r for r in least_squares.fits(df, "y", names, ["date"], "sector", {"all": (names, True), "one": (names[:1], False)}).collect()}
    assert sorted(got) == list(range(12)) and all(r.n == 40 for r in got.values())
    for date, ((b, rank), (b1, rank1)) in want.items():
        assert got[date]["all_rank"] == rank and got[date]["one_rank"] == rank1
        assert np.allclose(got[date]["all"], b, rtol=1e-6, atol=1e-6) and np.allclose(got[date]["one"], b1, rtol=1e-6, atol=1e-6)
    assert least_squares.fits(df.limit(0), "y", names, ["date"], "sector", {"all": (names, True)}).count() == 0


def test_pure_return_without_size_as_a_control_of_itself(spark):
    """A control of zeros changes nothing: the same as leaving it out."""
    rows = [(1, math.sin(i * 1.7), math.cos(i * 0.9), "xyz"[i % 3], math.sin(i * 0.4)) for i in range(40)]
    df = spark.createDataFrame(rows, "date long, f double, size double, sector string, ret double").withColumn("none", F.lit(0.0))
    one = stats.pure_and_raw_returns(df, "ret", "f", ["size"], ["date"], "sector").collect()[0]
    two = stats.pure_and_raw_returns(df, "ret", "f", ["size", "none"], ["date"], "sector").collect()[0]
    assert two.pure == pytest.approx(one.pure) and two.raw == pytest.approx(one.raw)
    flat = stats.pure_and_raw_returns(df.withColumn("f", F.lit(3.0)), "ret", "f", ["size"], ["date"], "sector").collect()[0]
    assert (flat.pure, flat.raw) == pytest.approx((0.0, 0.0), abs=1e-12)


def test_sector_neutral_drops_small_cells(spark):
    rows = [(month(0), f"s{i}", "small", float(i), 0.1, 1.0) for i in range(4)] + [(month(0), f"t{i}", "big", float(i), 0.1 * i, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "date date, symbol string, sector string, score double, ret double, cap double")
    got = books.sector_neutral(df, "score", "ret", "cap", "sector", 5).collect()
    assert len(got) == 1 and got[0].n_sec == 1 and got[0].traded == pytest.approx(2.0) and got[0].gross == pytest.approx(0.5 - 0.05)  # both legs are bought whole


def test_trailing_window_clamps_month_ends(spark):
    ics = spark.createDataFrame([("f", month(i), 0.01 * i) for i in range(31)], "factor string, date date, ic double")
    got = signals.trailing_ic(ics, ics.select("date"), ["f"]).orderBy("anchor").collect()
    assert got[0].anchor == D("2012-02-29") and got[0].n == 24
    row = next(r for r in got if r.anchor == D("2012-04-30"))
    assert row.n == sum(D("2009-03-30") <= month(i) < D("2012-03-30") for i in range(31))
    # A second factor that starts later, or is missing, keeps the anchors without history.
    late = ics.unionByName(ics.where("date >= '2010-05-01'").withColumn("factor", F.lit("g")))
    both = signals.trailing_ic(late, ics.select("date"), ["f", "g"]).groupBy("anchor").count().orderBy("anchor").collect()
    assert both[0]["count"] == 2 and both[0].anchor > got[0].anchor
    assert signals.trailing_ic(ics, ics.select("date"), ["f", "never"]).count() == 0


def test_weights_hold_from_anchor_to_anchor_and_start_equal(spark):
    """Worked by hand: seven months, anchors every third; only the second anchor has a history."""
    dates = spark.createDataFrame([(month(i),) for i in range(7)], "date date")
    blocks = signals.rebalance_blocks(dates)
    anchors = blocks.where("date = anchor").select("date")
    s = spark.createDataFrame([(month(3), "a", 24, 0.3, 1.0), (month(3), "b", 24, 0.1, 1.0)], "anchor date, factor string, n int, mean double, std double")
    w = signals.scheme_weights(s, anchors, ["a", "b"])
    assert {(r.anchor, r.has_history) for r in w.collect()} == {(month(0), False), (month(3), True), (month(6), False)}
    z = dates.select("date", F.lit("x").alias("symbol"), F.explode(F.array(F.struct(F.lit("a").alias("factor"), F.lit(1.0).alias("z")), F.struct(F.lit("b").alias("factor"), F.lit(-1.0).alias("z")))).alias("e")).select("date", "symbol", "e.*")
    z = z.unionByName(dates.select("date", F.lit("y").alias("symbol"), F.lit("a").alias("factor"), F.lit(2.0).alias("z")))
    got = {(r.scheme, r.date, r.symbol): r.score for r in signals.weighted_composite(z, w, blocks).collect()}
    assert len(got) == 4 * 7 * 2
    for i in range(7):
        assert got["ew", month(i), "x"] == pytest.approx(0.0) and got["ic", month(i), "y"] == pytest.approx(2.0)
        assert got["ic", month(i), "x"] == pytest.approx(0.75 - 0.25 if i in (3, 4, 5) else 0.0)
        assert got["ic_ir", month(i), "x"] == pytest.approx(0.25 if i in (3, 4, 5) else 0.0)


def test_cost_table_by_hand(spark):
    from quantloom.operators import metrics

    rows = [("s", month(i), 0.01 * (-1) ** i + 0.002, 1.0 + 0.5 * (i == 0)) for i in range(12)]
    market = spark.createDataFrame([(month(i), 0.01 * (-1) ** i) for i in range(12)], "date date, mkt double")
    got = {r.cost_bps: r for r in metrics.cost_table(spark.createDataFrame(rows, "series string, date date, gross double, traded double"), market, [0.0, 50.0], ["series"]).collect()}
    moved = (1.5 + 11) / 12
    for bps, r in got.items():
        assert r.turnover_pa == pytest.approx(moved * 6) and r.cost_drag == pytest.approx(moved * 12 * bps / 10000)
        assert r.beta == pytest.approx(1.0) and r.alpha == pytest.approx(0.024 - r.cost_drag)
        net = [g - t * bps / 10000 for _, _, g, t in rows]
        level, peak, worst = 1.0, 0.0, 0.0
        for x in net:
            level *= 1 + x
            peak = max(peak, level)
            worst = min(worst, level / peak - 1)
        assert r.max_drawdown == pytest.approx(worst) and r.cagr == pytest.approx(level - 1)


def test_scheme_weights(spark):
    s = spark.createDataFrame([(D("2012-01-31"), f, 36, m, 1.0) for f, m in (("a", 0.3), ("b", 0.1), ("c", -0.2))] + [(D("2012-02-29"), f, 36, -0.1, 1.0) for f in "abc"], "anchor date, factor string, n int, mean double, std double")
    w = {(r.scheme, str(r.anchor), r.factor): r.weight for r in signals.scheme_weights(s, s.select(F.col("anchor").alias("date")).distinct(), [*"abc"]).collect()}
    assert [w["ic", "2012-01-31", f] for f in "abc"] == pytest.approx([0.75, 0.25, 0.0])
    assert [w["ic_ir", "2012-01-31", f] for f in "abc"] == pytest.approx([0.375 + 1 / 6, 0.125 + 1 / 6, 1 / 6])
    assert all(w[k, "2012-02-29", f] == pytest.approx(1 / 3) for k in ("ew", "ic", "ic_ir", "t2") for f in "abc")


def test_revisions(spark):
    acts = [("a", "2020-01-01", "maintain"), ("a", "2020-01-10", "upgrade"), ("a", "2020-01-13", "downgrade")]
    df = spark.createDataFrame([(s, D(d), k) for s, d, k in acts], "symbol string, date date, action string")
    grid = spark.createDataFrame([(D("2019-12-31"),), (D("2020-01-09"),), (D("2020-01-12"),), (D("2020-01-13"),)], "date date")
    got = {str(r.date): (r.net, r.breadth) for r in signals.revisions(df, grid, {"net": 3}, 12).collect()}
    assert got == {"2019-12-31": (None, None), "2020-01-09": (0, None), "2020-01-12": (1, 1.0), "2020-01-13": (-1, 0.0)}


def test_statements_and_consolidation(spark):
    inc = spark.createDataFrame([("a", 1, D("2020-02-01"), 5), ("a", 1, D("2020-02-03"), 6)], "symbol string, fy int, accepted date, revenue int")
    bal = spark.createDataFrame([("a", 1, D("2020-03-01"), 7)], "symbol string, fy int, accepted date, assets int")
    got = point_in_time.combined_statements({"i": inc, "b": bal}, {"i": ["revenue"], "b": ["assets"]}, ["symbol", "fy"], "accepted").collect()
    assert [tuple(r) for r in got] == [("a", 1, D("2020-03-01"), 5, 7)]
    parts = spark.createDataFrame([("a", 1, None, 2), ("a", 2, 3, None), ("a", 3, 4, 5)], "k string, o int, x int, y int")
    assert [tuple(r) for r in point_in_time.consolidated(parts, ["k"], ["x", "y"], ["o"]).collect()] == [("a", 3, 2)]


def test_vendor_check_and_cleaning(spark):
    rows = [(s, month(i), (100 + 7 * ((i * 37 + len(s)) % 11)) * 1.0) for s in ("ok", "drift", "bad") for i in range(30)]
    a = spark.createDataFrame(rows, "symbol string, date date, price double")
    noise = {"ok": lambda i: 1.0, "drift": lambda i: 1.9 if i == 12 else 1.0, "bad": lambda i: [1.0, 1.6, 0.7][i * i % 3]}
    b = spark.createDataFrame([(s, d, p * noise[s](k % 30)) for k, (s, d, p) in enumerate(rows)], "symbol string, date date, price_b double")
    ob = point_in_time.vendor_observations(a, b, "price", "price_b")
    rep = point_in_time.vendor_report(ob)
    flags = {r.symbol: r.flag for r in rep.collect()}
    assert flags == {"ok": False, "drift": True, "bad": True}
    clean = point_in_time.cleaned(a, ob, rep, a.select("date").distinct())
    assert {r.symbol for r in clean.collect()} == {"ok", "drift"}
    drift = clean.where("symbol = 'drift'").orderBy("date").collect()
    assert drift[12].price is None and drift[11].ret_fwd_1 is None and drift[10].ret_fwd_1 is not None


def test_sector_lookup_and_screens(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    p, m = (spark.createDataFrame(r, "symbol string, sector string") for r in ([("a", "P"), ("b", None)], [("a", "M"), ("b", "M")]))
    assert column(point_in_time.sector_lookup(df, p, m), "sector", "symbol") == ["P", "M", "Unknown"]
    caps = spark.createDataFrame([("d", f"s{i:03d}", 1.0 if i in (199, 200) else 500.0 - i) for i in range(201)], "date string, symbol string, cap double")
    top = cross_section.top_n(caps, "cap", ["date"], "symbol", 200)
    assert top.count() == 200 and top.where("symbol = 's200'").count() == 0


def test_refreshed_value(spark):
    df = spark.createDataFrame([(10.0, 20.0, 100.0, 0.05, 150.0, 15.0), (10.0, None, 100.0, 0.05, 150.0, 15.0), (10.0, 500.0, 100.0, 0.05, 150.0, 15.0)], "now double, filing double, mcap double, y double, ev double, ebitda double")
    got = point_in_time.refreshed_value(df, "now", "filing", "mcap", ["y"], "ev", "ebitda").collect()
    assert [(r.price_ratio, r.y, r.mcap_live) for r in got] == [(2.0, 0.1, 50.0), (1.0, 0.05, 100.0), (10.0, 0.5, 10.0)]
    assert got[0].ebitda_to_ev == pytest.approx(15 / 100) and got[1]["size"] == pytest.approx(-math.log(100))


def test_text(spark):
    df = spark.createDataFrame([(1, "Good good, BAD"), (2, ""), (3, None), (4, "!!!")], "id int, t string")
    got = {r.id: r for r in text.sentiment(df, "id", "t", {"pos": ["good"], "neg": ["bad"]}, "pos", "neg").collect()}
    assert got[1].pos == pytest.approx(200 / 3) and got[1].net == pytest.approx(100 / 3) and got[1].word_count == 3
    assert all((got[k].pos, got[k].net, got[k].word_count) == (0.0, 0.0, 0) for k in (2, 3, 4))
    reply = spark.createDataFrame([('```json\n{"sentiment": 2, "capital_return_stance": "buyback"}\n```',), ("nothing",), (None,)], "r string")
    assert [(r.sentiment, r.capital_return_stance) for r in text.parsed_reply(reply, "r").collect()] == [(2, "buyback"), (None, None), (None, None)]
    assert text.truncated(df, "t", 6).where("id = 1").collect()[0].t == "Good g"


def test_folds(spark):
    dates = spark.createDataFrame([(month(i),) for i in range(75)], "date date")
    got = ml.folds(dates).collect()
    roles = {k: sorted(r.date for r in got if r.fold == 0 and r.role == k) for k in ("train", "validation", "test")}
    assert roles["test"] == [month(i) for i in range(60, 72)] and roles["validation"] == [month(i) for i in range(47, 59)] and roles["train"] == [month(i) for i in range(47)]
    assert {r.fold for r in got} == {0, 1} and sum(r.role == "test" for r in got) == 15
    assert ml.folds(dates.limit(10)).count() == 0


def test_walk_forward_fits_every_fold(spark):
    import random

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rnd = random.Random(3)
    rows = [(month(m), f"s{i}", rnd.random() if (m + i) % 9 else None, rnd.random(), rnd.gauss(0, 0.1)) for m in range(14) for i in range(12)]
    panel = spark.createDataFrame([(*r[:4], r[4] + (r[3] - 0.5) / 5) for r in rows], "date date, symbol string, a double, b double, ret double")
    parts = ml.folds(panel.select("date"), least=6, every=3, validation=2)
    got, importances = ml.walk_forward(panel, ["a", "b"], "ret", parts, trees=3, depth=2, least_rows=1, least_valid=1, least_fit=1, least_index=0)
    got = {(r.fold, r.date, r.symbol): r.prediction for r in got.collect()}
    assert set(got) == {(k, month(m), f"s{i}") for k, ms in ((0, (6, 7, 8)), (1, (9, 10, 11)), (2, (12, 13))) for m in ms for i in range(12)}
    inputs, want, weights = ["rk_a", "rk_b", "na_a", "na_b"], {}, []
    ranked = ml.ranked_features(panel, ["a", "b"]).join(panel.groupBy("date").agg(F.avg("ret").alias("mean")), "date").withColumn("target", F.col("ret") - F.col("mean"))
    ranked = VectorAssembler(inputCols=inputs, outputCol="x").transform(ranked)
    for k, start in enumerate((6, 9, 12)):
        train = ranked.where(F.col("date") < F.lit(month(start - 1))).withColumn("v", F.col("date") >= F.lit(month(start - 3)))
        model = GBTRegressor(featuresCol="x", labelCol="target", maxIter=3, maxDepth=2, seed=7, validationIndicatorCol="v").fit(train)
        test = ranked.where(F.col("date").between(month(start), month(start + 2)))
        want |= {(k, r.date, r.symbol): r.prediction for r in model.transform(test).collect()}
        weights.append(model.featureImportances.toArray())
    assert got == pytest.approx(want, abs=1e-9)
    assert {r.feature: r.importance for r in importances.collect()} == pytest.approx({c: sum(w[j] for w in weights) / 3 for j, c in enumerate(inputs)}, abs=1e-9)


def test_walk_forward_guards(spark):
    rows = [(month(m), f"s{i}", ((m * 7 + i * 3) % 11) / 10, ((m + i) % 5) / 50) for m in range(16) for i in range(10)]
    panel = spark.createDataFrame(rows, "date date, symbol string, a double, ret double")
    parts = ml.folds(panel.select("date"), least=6, every=3, validation=2)  # 4, 7, 10 and 13 as last training index... less the embargo
    fit = lambda **kw: {r.fold for r in ml.walk_forward(panel, ["a"], "ret", parts, trees=1, depth=1, **({"least_rows": 1, "least_valid": 1, "least_fit": 1, "least_index": 0} | kw))[0].collect()}
    assert fit() == {0, 1, 2, 3} and fit(least_index=10) == {2, 3} and fit(least_rows=75) == {1, 2, 3} and fit(least_rows=500) == set()
    # Without enough validation rows the fit goes on to the end and over all rows.
    short, _ = ml.walk_forward(panel, ["a"], "ret", parts, 1, trees=2, depth=2, least_rows=1, least_valid=200, least_fit=1, least_index=0)
    every, _ = ml.walk_forward(panel, ["a"], "ret", parts.withColumn("role", F.when(F.col("role") == "test", "test").otherwise("train")), 1, trees=2, depth=2, least_rows=1, least_valid=1, least_fit=1, least_index=0)
    key = lambda df: {(r.date, r.symbol): pytest.approx(r.prediction) for r in df.collect()}
    assert key(short) == {k: v.expected for k, v in key(every).items()}


def test_out_of_sample_ic_is_over_what_all_predict(spark):
    rows = [(month(m), f"s{i:02d}", float(i), float((i * 7 + m) % 25)) for m in range(3) for i in range(25)]
    panel = spark.createDataFrame(rows, "date date, symbol string, ret double, x double")
    good = panel.select("date", "symbol", F.col("ret").alias("prediction"))
    bad = panel.where(F.col("date") > month(0)).select("date", "symbol", (-F.col("ret")).alias("prediction"))
    got = {r.learner: r for r in ml.out_of_sample_ic(panel, "ret", {"good": good, "bad": bad}).collect()}
    assert {k: (r.n, r.mean, r.hit) for k, r in got.items()} == {"good": (2, 1.0, 1.0), "bad": (2, -1.0, 0.0)}
    base = {r.symbol: r.prediction for r in ml.linear_baseline(panel.where(F.col("date") == month(0)).withColumn("x", F.when(F.col("symbol") != "s03", F.col("x"))), ["ret", "x"]).collect()}
    assert base["s03"] == pytest.approx(4 / 25) and base["s00"] == pytest.approx((1 / 25 + 1 / 24) / 2)


def test_walk_forward_queries_cover_every_fold(spark):
    d = "/root/testdata/sf0.001"
    p = sample.labelled(spark, d)
    parts = ml.folds(p.select("date"))
    want = p.join(parts.where("role = 'test'"), "date").select("fold", "date", "symbol").collect()
    assert {r.fold for r in want} == {0, 1}
    assert sorted(map(tuple, plans.QUERIES["wf_predictions"](spark, d).select("fold", "date", "symbol").collect())) == sorted(map(tuple, want))
    got = {r.feature: r.importance for r in plans.QUERIES["wf_importances"](spark, d).collect()}
    assert set(got) == {f"{k}_{f}" for k in ("rk", "na") for f in sample.FACTORS} and sum(got.values()) == pytest.approx(1)


def test_every_lag_and_cost_of_the_reference(spark):
    d = "/root/testdata/sf0.001"
    assert {r.lag for r in plans.QUERIES["ic_decay"](spark, "/root/testdata/sf0.01").collect()} == set(range(1, 13))
    assert {r.cost_bps for r in plans.QUERIES["net_returns"](spark, d).collect()} == {0.0, 5.0, 10.0, 25.0, 50.0}
    assert {r.cost_bps for r in plans.QUERIES["cost_sensitivity"](spark, d).collect()} == {0.0, 5.0, 10.0, 25.0, 50.0}


def test_scalars_and_sources(spark, tmp_path):
    one = spark.createDataFrame([(1.0, None, 0.0, float("nan"))], "a double, b double, z double, n double")
    got = one.select(ratio("a", "z").alias("r"), clip("b", 0, 1).alias("c"), row_mean("a", "b").alias("m"), row_weighted_mean([("a", 2.0), ("b", 3.0)]).alias("w"), rounded("n").alias("n")).collect()[0]
    assert tuple(got) == (None, None, 1.0, 1.0, None)
    b = spark.createDataFrame([(D("2019-12-15"), D("2020-07-30"))], "first date, last date")
    assert column(month_ends(b), "date", "date") == [month(i, 2019) for i in range(11, 18)]
    assert column(quarter_ends(b), "date", "date") == [D("2019-12-31"), D("2020-03-31"), D("2020-06-30")]
    pages = spark.createDataFrame([("a", D("2020-01-01"), 2, 9.0), ("a", D("2020-01-01"), 1, 8.0)], "symbol string, date date, page int, price double")
    assert dedup_prices(pages).collect()[0].price == 8.0
    k = spark.createDataFrame([("e", "x=1")], "e string, p string").select(cache_key("e", "p").alias("k")).collect()[0].k
    assert len(k) == 16
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.IntegerType())])
    body = spark.createDataFrame([("s", '[{"x": 1}, {"x": 2}]'), ("t", "bad")], "symbol string, body string")
    assert [tuple(r) for r in parse_cached(body, "body", schema).collect()] == [("s", 1), ("s", 2)]
    assert read_present(body, T.StructType([T.StructField("symbol", T.StringType()), T.StructField("new", T.DoubleType())])).columns == ["symbol", "new"]
    io.write_parquet(one, str(tmp_path / "p"))
    assert io.read_parquet(spark, str(tmp_path / "p")).collect()[0].n is None
    io.write_csv(one.select("a"), str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), T.StructType([T.StructField("a", T.DoubleType())])).collect()[0].a == 1.0


def test_streaming_actions(spark, tmp_path):
    from quantloom.streaming.actions import sliding_actions

    rows = [(1, dt.datetime(2024, 1, 3, 5), "upgrade"), (1, dt.datetime(2024, 1, 4, 5), "downgrade"), (2, dt.datetime(2024, 1, 20), "upgrade")]
    df = spark.createDataFrame(rows, "s long, ts timestamp, a string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sliding_actions(stream, "ts", "s", "a").writeStream.format("memory").queryName("acts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = {(r.symbol, r.start, r.net) for r in spark.table("acts").collect()}
    batch = {(r.symbol, r.start, r.net) for r in sliding_actions(df, "ts", "s", "a").collect()}
    assert done and done <= batch


def test_pooled_hit_is_against_zero_not_the_median(spark):
    # Returns are all positive: against their median half would be hits by sign, against zero a hit is a high score.
    rows = [("k", float(i), 0.1 + 0.001 * ((7 * i) % 40)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, score double, ret double")
    r = stats.pooled_rank_ic(df, "score", "ret", ["k"]).collect()[0]
    above = [s > 19.5 for _, s, _ in rows]
    median = sorted(x for *_, x in rows)[19:21]
    assert r.n == 40 and r.hit == sum(above) / 40 == 0.5
    mixed = [(k, s, x - 0.105) for k, s, x in rows]
    r = stats.pooled_rank_ic(spark.createDataFrame(mixed, "k string, score double, ret double"), "score", "ret", ["k"]).collect()[0]
    want = sum((s > 19.5) == (x > 0) for _, s, x in mixed) / 40
    other = sum((s > 19.5) == (x + 0.105 > sum(median) / 2) for _, s, x in mixed) / 40
    assert r.hit == pytest.approx(want) and want != other


def test_pooled_ranks_of_ties_by_hand(spark):
    rows = [("k", x, y) for x, y in [(1.0, 2.0), (1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (3.0, 3.0)]]
    r = stats.pooled_rank_ic(spark.createDataFrame(rows, "k string, score double, ret double"), "score", "ret", ["k"], min_obs=5).collect()[0]
    rx, ry = [1.5, 1.5, 3, 4.5, 4.5], [2.5, 2.5, 1, 5, 4]
    mx, my = sum(rx) / 5, sum(ry) / 5
    want = sum((a - mx) * (b - my) for a, b in zip(rx, ry)) / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert r.ic == pytest.approx(want) and r.t == pytest.approx(want * math.sqrt(3) / math.sqrt(1 - want * want))


def test_pure_return_is_for_one_standard_deviation(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    f, size = rng.normal(5, 3, 60), rng.normal(10, 2, 60)
    sector = [["a", "b", "c"][i % 3] for i in range(60)]
    y = 0.01 * f + 0.02 * size + np.array([{"a": 0.1, "b": 0.2, "c": 0.0}[x] for x in sector]) + rng.normal(0, 0.01, 60)
    df = spark.createDataFrame([(1, float(a), float(b), s, float(r)) for a, b, s, r in zip(f, size, sector, y)], "date int, f double, size double, sector string, ret double")
    r = stats.pure_and_raw_returns(df, "ret", "f", ["size"], ["date"], "sector").collect()[0]
    z = lambda x: (x - x.mean()) / x.std()
    dummies = np.array([[s == "b", s == "c"] for s in sector], float)
    x = np.column_stack([np.ones(60), z(f), z(size), dummies])
    assert r.n == 60 and r.pure == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0][1])
    assert r.raw == pytest.approx(np.linalg.lstsq(x[:, :2], y, rcond=None)[0][1])


def test_fractile_report_by_hand(spark):
    rows = [(month(k), f"s{i}", float(i), 0.01 * i + 0.002 * k * (i % 3), 1.0 + i) for k in range(14) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, symbol string, score double, ret double, cap double")
    got = {r.row: r for r in books.fractile_report(df, "score", "ret", "cap", 5, False, []).collect()}
    assert set(got) == {"Q1", "Q2", "Q3", "Q4", "Q5", "Q1-Q5", "Market"} and got["Market"].active == 0 and got["Market"].turnover is None
    by = {d: [r for r in rows if r[0] == d] for d in {r[0] for r in rows}}
    mean = lambda xs: sum(xs) / len(xs)
    top = [mean([r[3] for r in sorted(by[d], key=lambda r: r[2])[-2:]]) for d in sorted(by)]
    market = [mean([r[3] for r in by[d]]) for d in sorted(by)]
    act = [a - b for a, b in zip(top, market)]
    std = lambda xs: math.sqrt(sum((x - mean(xs)) ** 2 for x in xs) / (len(xs) - 1))
    ann = lambda xs: math.prod(1 + x for x in xs) ** (12 / len(xs)) - 1
    q = got["Q1"]
    assert q.total == pytest.approx(ann(top)) and q.active == pytest.approx(ann(top) - ann(market)) and q.te == pytest.approx(std(act) * math.sqrt(12))
    assert q.t == pytest.approx(mean(act) / std(act) * math.sqrt(12) * math.sqrt(14 / 12)) and q.turnover == 0
    mt, mm = mean(top), mean(market)
    beta = sum((a - mt) * (b - mm) for a, b in zip(top, market)) / 13 / (sum((b - mm) ** 2 for b in market) / 14)
    assert q.beta == pytest.approx(beta) and q.alpha == pytest.approx((mt - beta * mm) * 12)


def test_master_and_local_panel_rules(spark):
    px = spark.createDataFrame([("A", D("2020-01-30"), 10.0), ("A", D("2020-03-31"), 30.0), ("B", D("2020-01-20"), 5.0)], "symbol string, date date, price double")
    dates = spark.createDataFrame([(D("2020-01-31"),), (D("2020-02-29"),), (D("2020-03-31"),)], "date date")
    grid = dates.crossJoin(spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"))
    filed = spark.createDataFrame([("A", D("2018-12-01"), 1.0), ("A", D("2020-02-10"), 2.0)], "symbol string, accepted date, g double")
    got = {(r.symbol, str(r.date)): r for r in point_in_time.master(grid, px, filed, spark.createDataFrame([("A", "Tech")], "symbol string, sector string"), dates, "accepted", ["g"]).collect()}
    a = got["A", "2020-01-31"]
    assert a.price == 10.0 and a.ret_fwd_1 is None and a.g == 1.0 and a.filing_lag_days == 426 and not a.fresh_filing and not a.investable and a.sector == "Tech"
    assert got["A", "2020-03-31"].investable and got["A", "2020-03-31"].g == 2.0 and got["A", "2020-02-29"].price is None
    assert got["B", "2020-01-31"].price is None and got["C", "2020-01-31"].sector == "Unknown" and not got["C", "2020-01-31"].has_fundamentals
    fund = spark.createDataFrame([("A", D("2019-12-31"), None, 7.0), ("B", D("2018-01-31"), D("2018-03-01"), 8.0)], "symbol string, fiscal_date date, accepted date, g double")
    caps = spark.createDataFrame([(s, d, c) for s, c in (("A", 100.0), ("B", 90.0)) for d in (D("2020-01-15"), D("2020-03-31"))], "symbol string, date date, mcap double")
    share = spark.createDataFrame([("A", 0.01), ("B", None)], "symbol string, ratio double")
    rows = {(r.symbol, str(r.date)): r for r in point_in_time.local_panel(px, fund, caps, share, ["g"], top=1, least=0).collect()}
    # A's float is held to 0.1, so B is the largest in January; its filing is older than 540 days. A's is known 90 days on.
    assert set(rows) == {("B", "2020-01-31"), ("A", "2020-03-31")} and rows["B", "2020-01-31"].g is None
    assert rows["A", "2020-03-31"].mcap == pytest.approx(10.0) and rows["A", "2020-03-31"].g == 7.0 and str(rows["A", "2020-03-31"].pit_date) == "2020-03-30"
    both = point_in_time.local_panel(px, fund, caps, share, ["g"], top=2, least=0).collect()
    assert [r.ret_fwd_1 for r in both if r.symbol == "A"][0] == 1.0  # 200 percent over two observed months, held to 100
    assert point_in_time.local_panel(px, fund, caps, share, ["g"], least=1).count() == 0


def test_event_returns_look_back_to_the_newest_close(spark):
    px = spark.createDataFrame([("A", D("2020-01-30"), 10.0), ("A", D("2020-02-27"), 12.0), ("A", D("2020-06-30"), 15.0)], "symbol string, date date, price double")
    ev = spark.createDataFrame([("A", D("2020-01-31"), 1), ("A", D("2020-01-29"), 2), ("Z", D("2020-01-31"), 3)], "symbol string, date date, id int")
    got = {r.id: r for r in point_in_time.event_returns(ev, px).collect()}
    assert got[1].ret_fwd_1 == pytest.approx(0.2) and got[1].ret_fwd_3 == pytest.approx(0.2) and got[1].ret_fwd_6 == pytest.approx(0.5)
    assert got[2].ret_fwd_1 is None and got[3].ret_fwd_1 is None


def test_slugs_and_tickers(spark):
    rows = spark.createDataFrame([("BHP.AX",), ("A.AX",), ("AB1.AX",), ("ABCDE.AX",), ("xyz",)], "s string")
    assert [r.s for r in rows.where(text.ordinary_ticker("s", ".AX")).collect()] == ["BHP.AX", "xyz"]
    assert spark.createDataFrame([(" Free Cash-Flow Yield! ",)], "s string").select(text.slug("s")).collect()[0][0] == "free_cash_flow_yield"


def test_compute_once_and_bulk(spark, tmp_path):
    from pyspark.sql import types as T

    from quantloom.sources import bulk, compute_once

    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert compute_once(spark, f"file://{tmp_path}/once", build).count() == 3
    assert len(calls) == 1
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.StringType()), T.StructField("x", T.DoubleType())])
    a = spark.createDataFrame([("b", "2020-01-02", 1.0), ("a", "bad", 2.0)], schema)
    b = spark.createDataFrame([("a", "2020-01-01")], "symbol string, date string")
    assert [(r.symbol, str(r.date), r.x) for r in bulk([a, b], schema, ["date"], ["symbol"]).collect()] == [("a", "2020-01-01", None), ("b", "2020-01-02", 1.0)]


def test_book_series_equal_the_books_one_by_one(spark):
    rng = random.Random(8)
    rows = [(dt.date(2020, 1 + m, 1), i, rng.choice([None, rng.gauss(0, 1), 0.5]), rng.gauss(0, 0.1), rng.uniform(1, 9)) for m, k in enumerate([23, 7, 4, 23, 11]) for i in range(k)]
    panel = spark.createDataFrame(rows, "date date, symbol long, score double, ret double, mcap double")
    legs = [("q", "top", 5, 4, True), ("d", "top", 10, 9, False), ("ls", "top", 5, 4, False), ("ls", "bot", 5, 0, False)]
    args = ("score", "ret", "mcap")
    want = {
        "q": books.long_book(panel, *args, 5, True),
        "d": books.long_book(panel, *args, 10, False),
        "ls": books.long_short(panel, *args, 5, False),
    }
    got = {(r.series, r.date): (r.gross, r.traded) for r in books.book_series(panel, *args, legs).collect()}
    one_by_one = {(k, r.date): (r.gross, r.traded) for k, b in want.items() for r in b.select("date", "gross", "traded").collect()}
    assert got.keys() == one_by_one.keys() and len(got) > 5
    for k, v in one_by_one.items():
        assert got[k] == pytest.approx(v)
