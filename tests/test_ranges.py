"""Two-level scans against one window over the whole group, with one key holding most rows."""

import random
from statistics import quantiles as plain_quantiles

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators import asof, cross_section, ranges, stats, time_series


@pytest.fixture(autouse=True)
def several_blocks(spark):
    """These tables are so small that their blocks would be joined."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(n=3000):
    rng = random.Random(3)
    return [(("hot" if i % 10 else rng.choice(["a", "b", None])), i, rng.choice([None, -0.02, 0.0, 0.01, rng.uniform(-0.05, 0.05)]), rng.choice([5, 5, 5, i])) for i in range(n)]


SCHEMA = "k string, t long, x double, v long"


def same(a, b, keys):
    rows = lambda df: {tuple(r[c] for c in keys): r for r in df.collect()}
    a, b = rows(a), rows(b)
    assert a.keys() == b.keys()
    for key, r in a.items():
        for c in r.asDict():
            assert r[c] == (pytest.approx(b[key][c]) if isinstance(r[c], float) else b[key][c]), (key, c)


def test_running_equals_one_window(spark):
    df = spark.createDataFrame(hot_rows(), SCHEMA).repartition(3)
    kinds = {"s": ("sum", "x"), "p": ("product", "y"), "hi": ("max", "x"), "lo": ("min", "v"), "at": ("last", "x")}
    df = df.withColumn("y", 1 + F.col("x"))
    rows = ranges.blocked(df, ["k"], ["t"])
    assert rows.where("k = 'hot'").select(ranges.BLOCK).distinct().count() > 2  # the hot key is in several tasks
    got = ranges.running(rows, ["k"], ["t"], **kinds).drop(ranges.BLOCK)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("x").over(w), "p": F.product("y").over(w), "hi": F.max("x").over(w), "lo": F.min("v").over(w), "at": F.last("x", ignorenulls=True).over(w)})
    same(got, want, ["k", "t"])
    assert ranges.running(ranges.blocked(df.limit(0), ["k"], ["t"]), ["k"], ["t"], **kinds).count() == 0


def test_ranks_quantiles_and_bounds_of_a_hot_key(spark):
    df = spark.createDataFrame([r for r in hot_rows() if r[0]], SCHEMA).repartition(3)
    got = ranges.with_ranks(df, "x", ["k"], "rk", "share")
    want = df.withColumn("rk", cross_section.avg_rank("x", ["k"])).withColumn("share", cross_section.pct_rank("x", ["k"]))
    same(got, want, ["k", "t"])
    found = {r.k: r for r in ranges.quantiles(ranges.value_ranks(df, "x", ["k"]), "x", ["k"], a=0.0, b=0.25, c=0.5, d=1.0).collect()}
    for key in ("hot", "a", "b"):
        x = sorted(r.x for r in df.where(F.col("k") == key).collect() if r.x is not None)
        quarters = plain_quantiles(x, n=4, method="inclusive")
        assert (found[key].n, found[key].a, found[key].d) == (len(x), x[0], x[-1])
        assert found[key].b == pytest.approx(quarters[0]) and found[key].c == pytest.approx(quarters[1])
    same(cross_section.winsorise(df, "x", ["k"], 0.1, 0.8, "w", wide=True), cross_section.winsorise(df, "x", ["k"], 0.1, 0.8, "w"), ["k", "t"])
    one = ranges.value_ranks(spark.createDataFrame([("z", 0, 2.0, 1), ("z", 1, None, 1)], SCHEMA), "x", ["k"])
    assert [tuple(r) for r in ranges.quantiles(one, "x", ["k"], m=0.5).collect()] == [("z", 1, 2.0)]


def test_pooled_ic_needs_no_window_over_a_key(spark):
    df = spark.createDataFrame([(k, t, x, float(v)) for k, t, x, v in hot_rows() if k], "k string, t long, x double, v double")
    (r,) = stats.pooled_rank_ic(df, "x", "v", ["k"], min_obs=1000).collect()
    pairs = df.where("k = 'hot' and x is not null").toPandas()
    assert r.n == len(pairs) and r.ic == pytest.approx(pairs.x.rank().corr(pairs.v.rank()))
    assert r.hit == pytest.approx(((pairs.x > pairs.x.median()) == (pairs.v > 0)).mean())


def test_wide_asof_equals_the_plain_one_with_a_hot_symbol(spark):
    rng = random.Random(7)
    symbol = lambda: "hot" if rng.random() < 0.9 else rng.choice("ab")
    day = lambda: f"2020-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    left = [(symbol(), day(), i) for i in range(1500)] + [("hot", "2020-06-15", 5000 + i) for i in range(800)] + [("none", "2020-01-01", 9000)]
    right = [(symbol(), day(), rng.choice([None, i]), i) for i in range(900)] + [("hot", None, 1, 1)]
    to = lambda df, c: df.withColumn(c, F.col(c).cast("date"))
    left = to(spark.createDataFrame(left, "s string, d string, i long"), "d").repartition(3)
    right = to(spark.createDataFrame(right, "s string, at string, v long, n long"), "at").repartition(3)
    for days in (None, 7):
        wide, plain = (asof.asof_join(left, right, ["s"], "d", "at", ["v", "n"], tie=["n"], within_days=days, wide=w) for w in (True, False))
        same(wide, plain, ["s", "i"])


def test_wide_drawdown_equals_the_plain_one(spark):
    df = spark.createDataFrame([r for r in hot_rows() if r[2] is not None], SCHEMA).repartition(3)
    same(time_series.with_drawdown(df, "x", ["k"], ["t"], wide=True), time_series.with_drawdown(df, "x", ["k"], "t"), ["k", "t"])
