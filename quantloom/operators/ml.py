"""Walk-forward ranking: expanding folds with an embargo, boosted trees by fold, importances over refits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import staged
from .cross_section import pct_rank


def date_index(dates: DataFrame) -> DataFrame:
    """(date, idx) from 0; one row a date."""
    return dates.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def folds(dates: DataFrame, least: int = 60, every: int = 12, embargo: int = 1, validation: int = 12) -> DataFrame:
    """(fold, date, role) with role test, validation or train: test blocks of `every` months from month `least` on,
    training on months up to test start - 1 - embargo, the last `validation` of them for early stopping."""
    idx = date_index(dates)
    last = idx.agg(F.max("idx").alias("last"))
    starts = last.select(F.explode(F.when(F.col("last") >= least, F.sequence(F.lit(least), F.col("last"), F.lit(every)))).alias("start")).withColumn("fold", ((F.col("start") - least) / every).cast("int"))
    stop = F.col("start") - embargo
    role = (
        F.when((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + every), "test")
        .when((F.col("idx") < stop) & (F.col("idx") >= stop - validation), "validation")
        .when(F.col("idx") < stop - validation, "train")
    )
    return idx.crossJoin(F.broadcast(starts)).select("fold", "date", role.alias("role")).where("role is not null")


def feature_ranks(panel: DataFrame, features: list[str], carry: list[str]) -> DataFrame:
    """(date, symbol, carry, rk_..): the features as percent ranks within the date. They are ranked in long form, a
    cross-section of one feature at a time, and brought together again by name: no task holds a date's whole rows once for
    each feature."""
    cells = F.array(*(F.struct(F.lit(i).alias("__f"), F.col(c).cast("double").alias("__x")) for i, c in enumerate(features)))
    long = panel.select("date", "symbol", *carry, F.inline(cells))
    ranks = long.withColumn("__r", pct_rank("__x", ["date", "__f"]))
    one = lambda i, c: F.max(F.when(F.col("__f") == i, F.col("__r"))).alias(f"rk_{c}")
    return ranks.groupBy("date", "symbol").agg(*(F.max(c).alias(c) for c in carry), *(one(i, c) for i, c in enumerate(features)))


def ranked_features(panel: DataFrame, features: list[str], carry: list[str] | None = None) -> DataFrame:
    """Features as percent ranks within the date (rk_..), nulls at the middle with an indicator (na_..), beside date, symbol
    and the columns in carry, by default all of the panel."""
    ranks = feature_ranks(panel, features, [c for c in panel.columns if c not in ("date", "symbol")] if carry is None else carry)
    ranks = ranks.withColumns({f"na_{f}": F.col(f"rk_{f}").isNull().cast("double") for f in features})
    return ranks.withColumns({f"rk_{f}": F.coalesce(f"rk_{f}", F.lit(0.5)) for f in features})


def first_learner(trees: int = 20, depth: int = 3, seed: int = 7):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed)


def second_learner(trees: int = 20, depth: int = 4, seed: int = 7):
    """Slower steps on samples of rows, deeper trees, leaves of at least 50 rows."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=50)


def walk_forward(
    panel: DataFrame, features: list[str], ret: str, fold_rows: DataFrame, max_folds: int | None = None, trees: int = 20, depth: int = 3, seed: int = 7,
    learner=None, least_rows: int = 500, least_valid: int = 200, least_fit: int = 300, least_index: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """((fold, date, symbol, prediction), (feature, importance)): one model a fold on the return less the month's mean, with
    early stopping on the fold's validation months. The loop is over refits, each a distributed fit.

    A fold is passed over if its last training month is before the least_index-th or fewer than least_rows rows have a
    target; with fewer than least_valid validation or least_fit other rows it is fitted on all of them to the end."""
    from pyspark.ml.feature import VectorAssembler

    means = panel.groupBy("date").agg(F.avg(ret).alias("__mean"))  # a row a date
    rows = ranked_features(panel, features, [ret]).join(F.broadcast(means), "date").withColumn("target", F.col(ret) - F.col("__mean")).drop("__mean")
    inputs = [f"{p}_{f}" for p in ("rk", "na") for f in features]
    rows = staged(rows.select("date", "symbol", "target", *inputs), "walk-forward")  # every fold and pass reads them
    rows = VectorAssembler(inputCols=inputs, outputCol="x").transform(rows).select("date", "symbol", "target", "x")
    spark, predictions, importances = panel.sparkSession, None, []
    past = fold_rows.where("role <> 'test'")
    labelled = rows.where("target is not null").groupBy("date").agg(F.count("*").alias("k"))  # a row a date
    held = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("k"))), F.lit(0)).alias(role)
    sizes = past.join(labelled, "date", "left").groupBy("fold").agg(F.count("*").alias("months"), held("train"), held("validation")).orderBy("fold").collect()  # a row a refit
    estimator = (learner or first_learner(trees, depth, seed)).setParams(featuresCol="x", labelCol="target")
    for size in sizes[:max_folds]:
        if size["months"] - 1 < least_index or size["train"] + size["validation"] < least_rows:
            continue
        k, stops = size["fold"], size["validation"] >= least_valid and size["train"] >= least_fit
        mine = rows.join(F.broadcast(fold_rows.where(F.col("fold") == k)), "date")
        train = mine.where((F.col("role") != "test") & F.col("target").isNotNull()).withColumn("v", F.col("role") == "validation")
        model = (estimator.copy({estimator.validationIndicatorCol: "v"}) if stops else estimator).fit(train)
        out = model.transform(mine.where("role = 'test'")).select("fold", "date", "symbol", "prediction")
        predictions = out if predictions is None else predictions.unionByName(out)
        importances += [(k, c, float(v)) for c, v in zip(inputs, model.featureImportances.toArray(), strict=True)]
    if predictions is None:
        predictions = fold_rows.limit(0).crossJoin(rows.select("symbol").limit(0)).select("fold", "date", "symbol", F.lit(0.0).alias("prediction"))
    weights = spark.createDataFrame(importances, "fold int, feature string, importance double").groupBy("feature").agg(F.avg("importance").alias("importance"))
    return predictions, weights


def linear_baseline(panel: DataFrame, features: list[str]) -> DataFrame:
    """(date, symbol, prediction): the mean of the features' percent ranks within the date, over those present."""
    from ..functions import row_mean

    return feature_ranks(panel, features, []).select("date", "symbol", row_mean(*(f"rk_{f}" for f in features)).alias("prediction"))


def out_of_sample_ics(panel: DataFrame, ret: str, predictions: dict[str, DataFrame], min_names: int = 20) -> DataFrame:
    """(learner, date, n, ic): monthly rank ICs of several predictions (date, symbol, prediction), over the names and months
    that all of them predict."""
    from .stats import rank_ic

    rows = panel.select("date", "symbol", ret)
    for name, p in predictions.items():
        rows = rows.join(p.select("date", "symbol", F.col("prediction").alias(f"__{name}")), ["date", "symbol"])
    names = [f"__{name}" for name in predictions]
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
    long = rows.unpivot(["date", ret], names, "learner", "score").withColumn("learner", F.substring("learner", 3, 1000))
    return rank_ic(long, "score", ret, ["learner", "date"], min_names)


def out_of_sample_ic(panel: DataFrame, ret: str, predictions: dict[str, DataFrame], min_names: int = 20) -> DataFrame:
    """(learner, n, mean, std, hit, ir, t) of out_of_sample_ics."""
    from .stats import series_stats

    return series_stats(out_of_sample_ics(panel, ret, predictions, min_names), "ic", ["learner"])
