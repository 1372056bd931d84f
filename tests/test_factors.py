"""Correlations, event windows and factor scores against pandas and by hand."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import books, screens, signals, stats
from quantloom.plans import screen


def test_correlations_equal_pandas_with_nulls_and_offsets(spark):
    rng = np.random.default_rng(2)
    names = [f"c{i}" for i in range(34)]
    x = rng.normal(size=(400, 34)) + rng.normal(size=(400, 1))
    x[:, 3] = x[:, 3] * 1e-3 + 1e6  # digits would be lost in plain sums
    x[:, 5] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {(r.a, r.b): r for r in stats.correlations(df, names).collect()}
    want, there = pdf.corr(), pdf.notna().astype(int)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = int((there[a] * there[b]).sum())
            assert (n == 0) == ((a, b) not in got)
            if n:
                r = got[a, b]
                assert r.n == n
                if "c5" in (a, b):
                    assert r.corr is None or abs(r.corr) < 1e-6
                else:
                    assert r.corr == pytest.approx(want.loc[a, b], abs=1e-7)
    assert stats.correlations(df.limit(0), names).count() == 0


def test_revisions_equal_a_count_of_events(spark):
    rng = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(500))
    acts = [("hot" if i % 10 else rng.choice("ab"), day(), rng.choice(["upgrade", "downgrade", "maintain"])) for i in range(1500)] + [("late", dt.date(2021, 5, 1), "maintain"), ("none", None, "upgrade")]
    grid = [dt.date(2019, 12, 1) + dt.timedelta(31 * i) for i in range(20)]
    df = spark.createDataFrame(acts, "symbol string, date date, action string").repartition(3)
    spans = {"m1": 31, "m12": 365}
    out = signals.revisions(df, spark.createDataFrame([(g,) for g in grid], "date date"), spans, 90)
    got = {(r.symbol, r.date): r for r in out.collect()}
    assert len(got) == 4 * len(grid)
    sign = {"upgrade": 1, "downgrade": -1, "maintain": 0}
    for s in ("hot", "a", "b", "late"):
        mine = [(d, sign[k]) for x, d, k in acts if x == s]
        for g in grid:
            r, inside = got[s, g], lambda n, g=g, mine=mine: [k for d, k in mine if g - dt.timedelta(n) < d <= g]
            if not any(d <= g for d, _ in mine):
                assert (r.m1, r.m12, r.breadth) == (None, None, None)
                continue
            assert (r.m1, r.m12) == (sum(inside(31)), sum(inside(365)))
            both = sum(map(abs, inside(90)))
            assert r.breadth == (pytest.approx(sum(inside(90)) / both) if both else None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # an event stays one row


def test_factor_scores_by_hand(spark):
    rows = [(1, f"s{i}", float(i), float(-i) if i != 2 else None, float(i % 2)) for i in range(5)]
    df = spark.createDataFrame(rows, "date int, symbol string, a double, b double, c double")
    got = {(r.symbol, r.name): r.value for r in signals.factor_scores(df, {"fam": ["a", "b"], "one": ["c"]}, {"size": ("a", True), "rev": ("c", False)}, ["date"]).collect()}
    assert [got[f"s{i}", "a_rk"] for i in range(5)] == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0])
    assert [got[f"s{i}", "b_rk"] for i in (0, 1, 3, 4)] == pytest.approx([1.0, 0.75, 0.5, 0.25]) and got["s2", "b_rk"] is None
    # Means 0.6, 0.575, 0.6 (a alone), 0.65, 0.625, ranked again: ties share theirs.
    assert [got[f"s{i}", "fam"] for i in range(5)] == pytest.approx([0.5, 0.2, 0.5, 1.0, 0.8])
    assert got["s1", "rev"] == pytest.approx(0.9) and got["s1", "one"] == pytest.approx(0.9) and got["s4", "size"] == pytest.approx(1.0)


def test_fractile_screen_by_hand(spark):
    rows = [("f", dt.date(2020, m, 28), f"s{i}", float(i if m < 3 else -i), 0.01 * i + 0.001 * m) for m in (1, 2, 3) for i in range(10)]
    (r,) = books.fractile_screen(spark.createDataFrame(rows, "factor string, date date, symbol string, value double, ret double"), "value", "ret", ["factor"], 10).collect()
    top = [0.09 - 0.045, 0.09 - 0.045, -0.045]
    assert r.act_top == pytest.approx(np.mean(top) * 12) and r.te_top == pytest.approx(np.std(top, ddof=1) * 12**0.5)
    assert r.act_ls == pytest.approx(np.mean([0.09, 0.09, -0.09]) * 12) and r.succ_top == pytest.approx(2 / 3) and r.succ_bot == pytest.approx(1 / 3)
    assert r.ir_top == pytest.approx(np.mean(top) / np.std(top, ddof=1) * 12**0.5)
    assert r.turn_top == pytest.approx(0.5) and r.turn_bot == pytest.approx(0.5)  # nothing, then one name for another


@pytest.mark.parametrize("numbers", [True, False])
def test_factor_screen_equals_windows(spark, numbers):
    rng, dates = random.Random(7), [dt.date(2020 + m // 12, m % 12 + 1, 28) for m in range(9)]
    some = lambda: rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(3)), -0.0])
    # The second month has eight names, the third fifteen, the fourth no ret; `flat` is constant, `rare` mostly missing and
    # held at its bounds where many names share one (101 names: the quantiles are values of the data).
    rows = [(d, f"s{i}", None if m == 3 else some(), some(), some(), some(), 1.0, rng.choice([None, None, None, 2.0]), 0.0 if i == 50 else rng.choice([1.0, 1.0, 2.0])) for m, d in enumerate(dates) for i in range({1: 8, 2: 15, 5: 101}.get(m, 70)) if m in (1, 2, 5) or rng.random() < 0.8]
    df = spark.createDataFrame(rows, "date date, symbol string, ret double, r2 double, a double, b double, flat double, rare double, held double").repartition(3)
    if numbers:
        df = df.withColumn("symbol", F.expr("cast(substr(symbol, 2) as long)"))
    families, alone = {"f": ["a", "b", "flat"], "g": ["rare", "b", "held"]}, {"size": ("a", True), "rev": ("b", False)}
    names = ["f", "a_rk", "b_rk", "flat_rk", "g", "rare_rk", "held_rk", "size", "rev"]
    long = signals.factor_scores(df, families, alone, ["date"], ["ret", "r2"])
    plain = {r.name: r for r in books.fractile_screen(long, "value", "ret", ["name"]).collect()}
    ics = {(r.name, r.ret): r for r in stats.series_stats(stats.rank_ics(long, "value", ["ret", "r2"], ["name", "date"]), "ic", ["name", "ret"]).collect()}
    got = screens.factor_screen(df, families, alone, names, ["ret", "r2"]).collect()
    assert sorted(names[r.place] for r in got) == sorted(names)
    near = lambda v: None if v is None else pytest.approx(v, abs=1e-9)
    for r in got:
        name = names[r.place]
        for i, ret in enumerate(("ret", "r2")):
            want = ics.get((name, ret))
            assert (r[f"mean{i}"], r[f"t{i}"], r[f"hit{i}"]) == (tuple(near(want[k]) for k in ("mean", "t", "hit")) if want else (None, None, None)), (name, ret)
        want = plain[name].asDict()
        assert {k: r[k] for k in want if k != "name"} == {k: near(v) for k, v in want.items() if k != "name"}, name


def test_factor_screen_of_an_empty_panel(spark):
    df = spark.createDataFrame([], "date date, symbol string, ret double, a double")
    assert screens.factor_screen(df, {"f": ["a"]}, {}, ["f", "a_rk"], ["ret"]).count() == 0


def test_the_screen_has_34_rows():
    assert len(screen.SCREENED) == 34 and len(screen.COMPONENTS) == 26 and len(screen.FAMILIES) == 6
