"""Stored tables: no exchange by key, renewed when their input changes, the old version in force until then."""

import time

import pytest

from quantloom.operators import asof, time_series
from quantloom.plans import wide
from quantloom.sources import store


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans_by_symbol_over_a_stored_table_have_no_exchange(spark):
    d = "/root/testdata/sf0.001"
    assert exchanges(wide.stored_returns(spark, d)) == 0 and exchanges(wide.stored_asof(spark, d)) == 0
    got, want = (time_series.with_drawdown(df.withColumn("ret", time_series.pct_change("price", ["symbol"])), "ret", ["symbol"]) for df in (wide.stored_prices(spark, d), wide.sample.px_daily(spark, d)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select("symbol", "date", "price", "volume").collect())) == sorted(map(key, want.select("symbol", "date", "price", "volume").collect()))
    assert exchanges(got) == 0 and exchanges(want) > 0


def test_a_changed_input_renews_the_table(spark, tmp_path):
    source, path, built = str(tmp_path / "in"), f"file://{tmp_path}/out", []

    def put(n):
        spark.range(n).selectExpr("id % 7 as symbol", "id as date", "id * 1.5 as price").write.mode("overwrite").parquet(source)
        time.sleep(0.01)

    def take(version="", fail=False):
        df = spark.read.parquet(source)

        def build():
            built.append(1)
            if fail:
                raise RuntimeError("no such luck")
            return df

        return store.stored(spark, path, build, [df], ["symbol"], ["date"], 4, version)

    put(50)
    assert take().count() == 50 and take().count() == 50 and len(built) == 1
    old = store.open_table(spark, path)
    put(80)
    with pytest.raises(RuntimeError):
        take(fail=True)
    assert store.open_table(spark, path).count() == 50  # what failed is not in force
    assert take().count() == 80 and old.count() == 50 and len(built) == 3
    assert take(version="2").count() == 80 and len(built) == 4
    assert len(store.versions(spark, path)) == 3
    store.prune(spark, path)
    assert len(store.versions(spark, path)) == 1 and store.open_table(spark, path).count() == 80
    assert exchanges(take("2").groupBy("symbol").count()) == 0
    with pytest.raises(FileNotFoundError):
        store.open_table(spark, f"file://{tmp_path}/none")


def test_a_stream_may_be_stored(spark, tmp_path):
    left = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", 1, 3)], "s string, t int, i int").selectExpr("s", "timestamp_seconds(t) as t", "i")
    right = spark.createDataFrame([("a", 4, 10), ("a", 5, 11), ("b", 2, 12)], "s string, u int, v int").selectExpr("s", "timestamp_seconds(u) as u", "v")
    rows = store.stored(spark, f"file://{tmp_path}/s", lambda: asof.stream(left, right, ["s"], "t", "u", ["v"]), [], ["s"], ["__t", "__side"], 2)
    got = asof.carried(rows, ["s"], "u")
    assert sorted((r.i, r.v) for r in got.collect()) == [(1, 11), (2, 11), (3, None)] and exchanges(got) == 0


def test_compute_once_notices_a_changed_input(spark, tmp_path):
    from quantloom.sources import compute_once

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (5, 5, 8):
        spark.range(n).write.mode("overwrite").parquet(source)
        df = spark.read.parquet(source)
        assert compute_once(spark, path, lambda df=df: df, [df]).count() == n
    spark.range(2).write.mode("overwrite").parquet(source)
    assert compute_once(spark, path, lambda: spark.range(99)).count() == 8  # without inputs: any finished write will do
