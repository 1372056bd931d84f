"""Correlations, information coefficients and small regressions as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complete, ratio
from .cross_section import avg_rank
from .least_squares import fits
from .ranges import average_rank, quantiles, value_ranks


def corr(x: str, y: str, rows: Column | None = None) -> Column:
    """Pearson correlation from sums; null where a side is constant. rows: the count of pairs, if some rows are null in both."""
    n, xy = F.count("*") if rows is None else rows, F.sum(F.col(x) * F.col(y))
    sx, sy = F.sum(x), F.sum(y)
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - sx * sx, n * F.sum(F.col(y) * F.col(y)) - sy * sy
    return ratio(n * xy - sx * sy, F.sqrt(F.greatest(vx * vy, F.lit(0.0))))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation by covariance, for values of any scale; null where a side is constant."""
    return ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def rank_ic(df: DataFrame, score: str, ret: str, keys: list[str], min_names: int = 20) -> DataFrame:
    """Spearman correlation of score and ret for each key: average ranks over complete pairs."""
    pairs = df.where(complete(score, ret))
    ranked = pairs.withColumn("__x", avg_rank(score, keys)).withColumn("__y", avg_rank(ret, keys))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), corr("__x", "__y").alias("ic")).where(F.col("n") >= min_names)


def rank_ics(df: DataFrame, score: str, rets: list[str], keys: list[str], min_names: int = 20) -> DataFrame:
    """(keys, ret, n, ic): rank_ic of score with each of several returns, ranked in one pass over the rows."""
    there = lambda c, other, out: F.when(F.col(other).isNotNull(), F.col(c)).alias(out)
    rows = df.select(*keys, *(there(score, r, f"__x{i}") for i, r in enumerate(rets)), *(there(r, score, f"__y{i}") for i, r in enumerate(rets)))
    for i in range(len(rets)):
        for c in (f"__x{i}", f"__y{i}"):
            rows = rows.withColumn(c, avg_rank(c, keys))
    one = lambda i: (F.count(f"__x{i}").alias(f"__n{i}"), corr(f"__x{i}", f"__y{i}", F.count(f"__x{i}")).alias(f"__c{i}"))
    found = rows.groupBy(*keys).agg(*(c for i in range(len(rets)) for c in one(i)))
    each = F.array(*(F.struct(F.lit(r).alias("ret"), F.col(f"__n{i}").alias("n"), F.col(f"__c{i}").alias("ic")) for i, r in enumerate(rets)))
    return found.select(*keys, F.inline(each)).where(F.col("n") >= min_names)


def pooled_rank_ic(df: DataFrame, score: str, ret: str, keys: list[str], min_obs: int = 30) -> DataFrame:
    """Spearman over all rows of each key, its t statistic, and how often the score lies above its median where the
    return is above zero. Rows are counted by distinct pair first; ranks and the median come from ranges of distinct values,
    so no task holds more of a key than its share of them."""
    pairs = df.where(complete(score, ret)).groupBy(*keys, F.col(score).alias("__s"), F.col(ret).alias("__r")).agg(F.count("*").alias("__c"))
    by_score, by_ret = value_ranks(pairs, "__s", keys, "__c"), value_ranks(pairs, "__r", keys, "__c")
    ranked = pairs.join(quantiles(by_score, "__s", keys, __m=0.5).drop("n"), keys)
    ranked = ranked.join(by_score.select(*keys, "__s", average_rank().alias("__x")), [*keys, "__s"])
    ranked = ranked.join(by_ret.select(*keys, "__r", average_rank().alias("__y")), [*keys, "__r"])
    c, x, y = F.col("__c"), F.col("__x"), F.col("__y")
    n, sx, sy = F.sum(c), F.sum(c * x), F.sum(c * y)
    vx, vy = n * F.sum(c * x * x) - sx * sx, n * F.sum(c * y * y) - sy * sy
    hit = F.when((F.col("__s") > F.col("__m")) == (F.col("__r") > 0), c.cast("double")).otherwise(0.0)
    ic = ratio(n * F.sum(c * x * y) - sx * sy, F.sqrt(F.greatest(vx * vy, F.lit(0.0))))
    out = ranked.groupBy(*keys).agg(n.alias("n"), ic.alias("ic"), ratio(F.sum(hit), n).alias("hit")).where(F.col("n") >= min_obs)
    return out.withColumn("t", ratio(F.col("ic") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("ic") * F.col("ic"))))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, cov, corr) of every two columns, a before b in the list, over the rows complete in both. A task reduces its
    rows to one set of matrices (counts, sums, cross products), and these are summed, so what is shuffled doesn't grow with
    the rows. Values are taken from a common shift, the mean of a few rows, which changes no result but keeps digits."""
    first = df.select(*columns).limit(1000).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])
    p = len(columns)
    i, j = np.triu_indices(p, 1)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, p, p))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            sx = x.T @ m
            sxx = (x * x).T @ m
            sums += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, x.T @ x])
        names = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(s[i, j]) for s in sums)], names=names)

    parts = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(reduced, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).where("n > 0")
    names = F.array(*map(F.lit, columns))
    s = s.withColumn("cov", ratio(F.expr("sxy - sx * sy / n"), F.col("n") - 1))
    spread = F.sqrt(F.greatest(F.expr("sxx - sx * sx / n"), F.lit(0.0))) * F.sqrt(F.greatest(F.expr("syy - sy * sy / n"), F.lit(0.0)))
    return s.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), F.col("n").cast("long").alias("n"), "cov", ratio(F.expr("sxy - sx * sy / n"), spread).alias("corr"))


def series_stats(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """mean, std, ir, t = ir * sqrt(n), hit and n of a series."""
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("hit"), F.count("*").alias("n")
    )
    return out.withColumn("ir", ratio("mean", "std")).withColumn("t", F.col("ir") * F.sqrt("n"))


def capm(df: DataFrame, ret: str, market: str, keys: list[str], min_obs: int = 12, per_year: int = 12) -> DataFrame:
    """Slope and yearly intercept of ret on market over complete rows."""
    out = df.where(complete(ret, market)).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(ret, market).alias("beta"), F.regr_intercept(ret, market).alias("alpha"))
    enough = F.col("n") >= min_obs
    return out.select(*keys, "n", F.when(enough, F.col("beta")).alias("beta"), F.when(enough, F.col("alpha") * per_year).alias("alpha"))


def biased_beta(ret: str, market: str) -> Column:
    """Sample covariance over population variance."""
    return ratio(F.covar_samp(ret, market), F.var_pop(market))


def demeaned_slope(df: DataFrame, y: str, x: list[str], keys: list[str], group: str, min_names: int = 30) -> DataFrame:
    """(keys, n, coef): for each key the coefficient of x[0] in least squares of y on x and dummies of `group`; of least norm
    where the regressors leave it open."""
    found = fits(df, y, x, keys, group, {"all": (x, True)}, min_names)
    return found.select(*keys, "n", F.get("all", F.lit(0)).alias("coef"))


def pure_and_raw_returns(df: DataFrame, ret: str, factor: str, controls: list[str], keys: list[str], group: str, min_names: int = 30) -> DataFrame:
    """(keys, n, pure, raw): for each key the coefficient of the factor's z-score (ddof 0, over the key's complete rows)
    in least squares of ret on it, the controls' z-scores and dummies of `group`, and on it alone; both from one set of
    sums. The z-score of a constant is 0, and so is its coefficient: a control of zeros is as good as none."""
    from .cross_section import zscore

    x = [factor, *controls]
    rows = df.where(complete(ret, *x, group))
    rows = rows.select(*keys, group, ret, *(F.coalesce(zscore(c, keys, 0), F.lit(0.0)).alias(c) for c in x))
    found = fits(rows, ret, x, keys, group, {"pure": (x, True), "raw": ([factor], False)}, min_names)
    return found.select(*keys, "n", *(F.get(c, F.lit(0)).alias(c) for c in ("pure", "raw")))
