"""Plans that hold at size: exchanges, sorts and checkpoints are counted; results against plainer versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import asof, books, cross_section, ml, point_in_time, signals, stats, time_series
from quantloom.plans import QUERIES, reports, screen
from quantloom.sources import shared


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cross(spark, seed=3):
    rng = random.Random(seed)
    rows = [(k, i, rng.choice([None, 0.0, 1.0, 2.0, rng.random(), rng.gauss(0, 9)])) for k, n in (("a", 700), ("b", 7), ("c", 1)) for i in range(n)]
    rows += [("d", i, 4.0) for i in range(5)] + [("e", i, None) for i in range(3)]
    return spark.createDataFrame(rows, "k string, i int, x double").repartition(3)


def test_winsorised_rank_is_the_rank_of_the_winsorised_value(spark):
    df = cross(spark)
    got = {(r.k, r.i): r.r for r in cross_section.winsorised_rank(df, "x", ["k"], "r").collect()}
    plain = cross_section.winsorise(df, "x", ["k"]).withColumn("r", cross_section.pct_rank("x", ["k"]))
    assert got == {(r.k, r.i): pytest.approx(r.r) if r.r is not None else None for r in plain.collect()}


def test_a_rank_costs_one_sort(spark):
    df = cross(spark).withColumn("r", cross_section.pct_rank("x", ["k"]))
    assert executed(df).count("Sort [") == 1


def test_factor_scores_have_one_exchange_and_no_percentiles(spark):
    df = spark.createDataFrame([(1, f"s{i}", float(i), float(-i)) for i in range(5)], "date int, symbol string, a double, b double")
    plan = executed(signals.factor_scores(df, {"f": ["a", "b"], "g": ["b"]}, {"size": ("a", True)}, ["date"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "percentile" not in plan


def test_rank_ics_equal_rank_ic(spark):
    rng = random.Random(5)
    some = lambda: rng.choice([None, rng.random(), float(rng.randrange(5))])
    df = spark.createDataFrame([(i % 3, some(), some(), some()) for i in range(400)], "k int, x double, a double, b double")
    got = {(r.k, r.ret): (r.n, r.ic) for r in stats.rank_ics(df, "x", ["a", "b"], ["k"]).collect()}
    for ret in ("a", "b"):
        for r in stats.rank_ic(df, "x", ret, ["k"]).collect():
            assert got.pop((r.k, ret)) == (r.n, pytest.approx(r.ic))
    assert not got


def test_the_screen_reads_its_ranked_rows_once(spark):
    rows = [("f", dt.date(2020, m, 28), f"s{i}", float(i), 0.01 * i) for m in (1, 2) for i in range(10)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "factor string, date date, symbol string, value double, ret double")
    df = df.mapInArrow(count, df.schema)
    assert books.fractile_screen(df, "value", "ret", ["factor"], 10).count() == 1 and seen.value == 20


def test_the_factor_screen_reads_its_panel_once(spark, monkeypatch):
    rng, seen = random.Random(9), spark.sparkContext.accumulator(0)
    names = ["ret", "r2", *screen.COMPONENTS]
    rows = [(dt.date(2020, m, 28), i, *(rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in names)) for m in (1, 2, 3) for i in range(60)]

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, f"date date, symbol long, {', '.join(f'{c} double' for c in names)}")
    monkeypatch.setattr(screen, "components", lambda s, d: df.mapInArrow(count, df.schema))
    got = QUERIES["factor_screen"](spark, "").collect()
    assert sorted(r.place for r in got) == list(range(34)) and all(r.ic_1m is not None and r.turn_top is not None for r in got)
    assert seen.value == len(rows)


def test_the_panel_of_the_screen_reads_its_table_once(spark):
    plan = executed(screen.components(spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_sums_of_the_last_days_equal_a_count(spark):
    rng = random.Random(11)
    days = sorted({dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(800)) for _ in range(60)})
    rows = [(s, d, rng.choice([-1, 0, 1])) for s in "ab" for d in days if s == "a" or rng.random() < 0.5] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "symbol string, date date, x int").repartition(3)
    got = {(r.symbol, r.date): (r.q, r.y) for r in df.withColumns({"q": time_series.within("x", 92, ["symbol"]), "y": time_series.within("x", 365, ["symbol"])}).collect()}
    for s, d, _ in rows[:-1]:
        inside = lambda n, s=s, d=d: sum(x for k, e, x in rows[:-1] if k == s and d - dt.timedelta(n) < e <= d)
        assert got[s, d] == (inside(92), inside(365))


@pytest.mark.parametrize("wide", [False, True])
def test_asof_grid_equals_asof_join_of_the_grid(spark, wide):
    rng = random.Random(8)
    day = lambda: rng.choice([None, dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(60))])
    rows = [(rng.choice(["hot", "hot", "hot", None, *"abcdef"]), day(), i, rng.choice([None, 1.0, 2.0])) for i in range(300)] + [("none", None, 900, 1.0), ("none", None, 901, 2.0)]
    right = spark.createDataFrame(rows, "symbol string, seen date, k int, v double").repartition(5)
    grid = spark.createDataFrame([(dt.date(2019, 12, 20) + dt.timedelta(9 * i),) for i in range(10)], "date date")
    args = (["symbol"], "date", "seen", ["v"])
    plain = asof.asof_join(right.select("symbol").distinct().crossJoin(grid), right, *args, tie=["k"], within_days=30)
    key = lambda r: (str(r.symbol), r.date, str(r.seen), str(r.v))
    got = asof.asof_grid(right, ["symbol"], grid, *args[1:], tie=["k"], within_days=30, wide=wide)
    if not wide:
        assert executed(got).count("Exchange hashpartitioning") == 1  # the grid's dates are not shuffled
    assert got.columns == plain.columns and sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))


def test_features_are_ranked_one_cross_section_at_a_time(spark):
    df = spark.createDataFrame([(1, f"s{i}", 0.1 * i, float(i), float(-i), 1.0) for i in range(6)], "date int, symbol string, ret double, a double, b double, c double")
    ranked = ml.ranked_features(df, ["a", "b", "c"], ["ret"])
    assert executed(ranked).count("Sort [") == 1
    assert {r.symbol: (r.ret, r.rk_a, r.na_a) for r in ranked.collect()} == {f"s{i}": pytest.approx((0.1 * i, (i + 1) / 6, 0.0)) for i in range(6)}


def test_walk_forward_reads_its_panel_twice_however_many_folds(spark):
    seen, rng = spark.sparkContext.accumulator(0), random.Random(1)
    month = lambda m: dt.date(2000 + m // 12, m % 12 + 1, 28)
    df = spark.createDataFrame([(month(m), f"s{i}", rng.random(), rng.random()) for m in range(40) for i in range(5)], "date date, symbol string, ret double, a double")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    parts = ml.folds(df.select("date"), least=10, every=12, validation=3)
    rows = df.mapInArrow(count, df.schema)
    ml.walk_forward(rows, ["a"], "ret", parts, trees=1, depth=1, least_rows=1, least_valid=1, least_fit=1, least_index=0)[1].collect()
    assert seen.value <= 400


def test_event_returns_send_on_only_prices_of_symbols_with_events(spark):
    day = lambda m, d=1: dt.date(2020, m, d)
    events = spark.createDataFrame([("a", day(1), 7), ("a", day(1), 7), ("a", day(2), 8), (None, day(1), 9)], "symbol string, date date, id int")
    lines = spark.createDataFrame([(s, day(m), float(m)) for s in "abcdefgh" for m in range(1, 9)], "symbol string, date date, p double")
    got = point_in_time.event_returns(events, lines.groupBy("symbol", "date").agg(F.avg("p").alias("price")))
    plan = executed(got)
    assert plan.index("avg(p") < plan.index("LeftSemi")  # the join lies below the aggregate
    rows = sorted((str(r.symbol), r.date, r.id, r.ret_fwd_1, r.ret_fwd_3, r.ret_fwd_6) for r in got.collect())
    assert rows == [("None", day(1), 9, None, None, None), ("a", day(1), 7, 1.0, 3.0, 6.0), ("a", day(1), 7, 1.0, 3.0, 6.0), ("a", day(2), 8, 0.5, 1.5, 3.0)]


def test_the_summary_reads_one_exchange_of_the_long_panel(spark):
    rng = random.Random(2)
    rows = [(dt.date(2000 + m // 12, m % 12 + 1, 28), f"s{i:02}", rng.gauss(0, 1), 1.0 + i, "ab"[i % 2], rng.random(), rng.random()) for m in range(15) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, symbol string, ret double, mcap double, sector string, f1 double, f2 double")
    got = reports.summarised(df, ["f1", "f2"])
    assert {r.factor for r in got.collect()} == {"f1", "f2"}
    final = executed(got).split("== Initial Plan ==")[0].split("\n")
    panels = [line for line in final if "REPARTITION" in line and "symbol" not in line and "Reused" not in line]
    assert len(panels) == 1 and sum("ReusedExchange" in line and "__row" in line for line in final) >= 3


@pytest.mark.parametrize("cap_weighted", [False, True])
def test_turnover_by_counts_is_that_of_weights(spark, cap_weighted):
    rng = random.Random(4)
    rows = [(k, dt.date(2020, m, 28), f"s{i}", rng.random(), rng.gauss(0, 0.1), 1.0 + i) for k in "xy" for m in range(1, 13) for i in range(30) if rng.random() < 0.7 and (k, m) != ("x", 5)]
    df = spark.createDataFrame(rows, "f string, date date, symbol string, score double, ret double, cap double")
    report = books.fractile_report(df, "score", "ret", "cap", 5, cap_weighted, ["f"]).collect()
    assert sorted(r.row for r in report if r.f == "x") == ["Market", "Q1", "Q1-Q5", "Q2", "Q3", "Q4", "Q5"]
    for k in "xy":
        one = df.where(F.col("f") == k)
        want = {f"Q{r.fractile}": pytest.approx(r.turnover) for r in books.name_turnover(one, "score", "ret", "cap", 5).collect()}
        assert {r.row: r.turnover for r in report if r.f == k and r.turnover is not None} == want


def test_lags_are_dealt_out_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(dt.date(2020, m, 28), i, rng.random(), rng.random()) for m in range(1, 7) for i in range(200)], "date date, symbol int, score double, ret double")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    size = sum(f.stat().st_size for f in (tmp_path / "p").glob("part-*.parquet"))
    monkeypatch.setattr(shared, "TASK_BYTES", 1000)
    got = signals.ic_decay(stored, "score", "ret", 2)
    assert f"{-(-size // 1000)}), REPARTITION_BY_NUM" in executed(got)
    assert {r.lag: r.n for r in got.collect()} == {1: 6, 2: 5}
