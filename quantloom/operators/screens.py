"""The screen of many factors: ranks, information coefficients and outer fractiles of a family's cross-section in one pass.

Spark deals a name's values of a family, as one row, to the family's cross-section at a date; there numpy sorts each
component and each score once, and ranks, pairs and fractiles are read off these orders. Window functions would sort the
long panel five times a score. What leaves a task is a row a score: its figures, and the names of its outer fractiles. A task
holds one cross-section at a time (a row a name of one family); there are as many of them as families times dates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratio
from ..sources.shared import dealt, staged
from .books import active_stats, fractile_turnover
from .signals import family_values, score_names


def _places(v: np.ndarray) -> np.ndarray:
    """Ranks of sorted values, ties at their average."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(v), 1), bool), v[1:] != v[:-1]]))
    last = np.append(first[1:], len(v))
    return np.repeat((first + 1 + last) / 2.0, last - first)


def _order(v: np.ndarray) -> np.ndarray:
    """The positions of the values there are, by value and then by position."""
    return np.argsort(v, kind="stable")[: len(v) - np.count_nonzero(np.isnan(v))]


def _pct(v: np.ndarray, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Average rank divided by the number of values, NaN for NaN; with bounds, of the value held within these quantiles."""
    order, out = _order(v), np.full(len(v), np.nan)
    held, n = v[order], len(order)
    if n and low is not None and high is not None:
        ends = []
        for at in ((n - 1) * low, (n - 1) * high):
            a, b = held[int(np.floor(at))], held[int(np.ceil(at))]
            ends.append(a if a == b else (np.ceil(at) - at) * a + (at - np.floor(at)) * b)
        held = np.clip(held, *ends)
    out[order] = _places(held) / max(n, 1)
    return out


def _mean(columns: list[np.ndarray]) -> np.ndarray:
    """Mean across columns over those present, to ten digits, so that ties are ties."""
    total, n = np.zeros(len(columns[0])), np.zeros(len(columns[0]))
    for c in columns:
        total, n = total + np.where(np.isnan(c), 0.0, c), n + ~np.isnan(c)
    mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
    return np.floor(mean * 1e10 + 0.5) / 1e10


def _ic(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation of two sets of ranks, which have the same mean; null where a side is constant."""
    mid = (len(x) + 1) / 2.0
    x, y = x - mid, y - mid
    spread = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / spread) if spread > 0 else None


def _scored(values: list[np.ndarray], again: bool, wanted: list[int | None]) -> list[tuple[int, np.ndarray]]:
    """(place, score) of a cross-section's composite and components, for the places that are wanted; `wanted` has the
    composite's first."""
    ranks = [_pct(v, 0.01, 0.99) for v in values]
    mean = _mean(ranks)
    return [(k, score) for k, score in zip(wanted, [_pct(mean) if again else mean, *ranks], strict=True) if k is not None]


def _figures(score: np.ndarray, rets: list[np.ndarray], by_ret: list[np.ndarray], n: int, min_names: int) -> tuple[dict[str, float | None], np.ndarray, np.ndarray]:
    """The ICs of a score with each return, and of the first return the means of all, top and bottom names; then the
    positions of top and bottom. by_ret: the orders of the returns."""
    by_score, there = _order(score), ~np.isnan(score)
    place, found = np.empty(len(score)), {}
    top = bottom = by_score[:0]
    for i, (r, order) in enumerate(zip(rets, by_ret, strict=True)):
        at = by_score[~np.isnan(r[by_score])]
        size = len(at)
        if size >= min_names:
            other = order[there[order]]
            place[other] = _places(r[other])
            found[f"ic{i}"] = _ic(_places(score[at]), place[at])
        if i == 0 and size >= n:
            fractile = np.maximum((np.arange(size) * n + size - 2) // max(size - 1, 1) - 1, 0)
            top, bottom = at[fractile == n - 1], at[fractile == 0]
            found |= {"all": r[at].mean(), "top": r[top].mean(), "bot": r[bottom].mean()}
    return found, top, bottom


def cross_sections(panel: DataFrame, families: dict[str, list[str]], alone: dict[str, tuple[str, bool]], names: list[str], rets: list[str], keys: list[str], n: int = 10, min_names: int = 20) -> DataFrame:
    """A row for each of `names` (of factor_scores), as its `place` in them, and keys: ic0, ic1, .. (the rank IC with each of
    rets), and of the first return the means of all names, of the top and of the bottom fractile (of n), and who is in the
    latter two: arrays `highest` and `lowest`, empty where there are fewer than n names. NaN counts as null."""
    groups, place = families | {k: [c] for k, (c, _) in alone.items()}, {name: i for i, name in reversed([*enumerate(names)])}
    wanted = {f: [place.get(x) for x in own] for f, own in score_names(families, alone).items()}
    once, width = [k for k, (_, again) in alone.items() if not again], len(rets)
    figures, symbols = [*(f"ic{i}" for i in range(width)), "all", "top", "bot"], T.ArrayType(panel.schema["symbol"].dataType)
    fields = [panel.schema[k] for k in keys] + [T.StructField("place", T.IntegerType())] + [T.StructField(k, T.DoubleType()) for k in figures]
    schema = T.StructType([*fields, T.StructField("highest", symbols), T.StructField("lowest", symbols)])

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        family = key[-1].as_py()
        rows = rows.take(pc.sort_indices(rows["symbol"], null_placement="at_start"))  # names in order: ties go by name
        symbol, k = rows["symbol"].combine_chunks(), width + len(groups[family])
        columns = [np.ascontiguousarray(c) for c in pc.list_flatten(rows["__v"]).to_numpy().reshape(-1, k).T]
        back, scored = columns[:width], _scored(columns[width:], family not in once, wanted[family])
        by_ret = [_order(r) for r in back]
        found = [_figures(score, back, by_ret, n, min_names) for _, score in scored]

        def who(side: int) -> pa.Array:
            parts = [f[side] for f in found]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), symbol.take(pa.array(np.concatenate([np.empty(0, np.int64), *parts]))))

        out = {c: pa.repeat(v, len(found)) for c, v in zip(keys, key, strict=False)} | {"place": pa.array([at for at, _ in scored], pa.int32())}
        return pa.table(out | {c: pa.array([f[0].get(c) for f in found], pa.float64()) for c in figures} | {"highest": who(1), "lowest": who(2)})

    rows = dealt(family_values(panel, groups, keys, rets), *keys, "family")
    return rows.groupBy(*keys, "family").applyInArrow(one, schema)  # an array is one Arrow column: cheaper than its values as columns


def factor_screen(panel: DataFrame, families: dict[str, list[str]], alone: dict[str, tuple[str, bool]], names: list[str], rets: list[str], n: int = 10, min_names: int = 20, per_year: int = 12) -> DataFrame:
    """A row for each of `names`, as its `place` in them: mean0, t0, hit0, mean1, .. of the monthly rank ICs with each of rets,
    and what `fractile_screen` has of the first. The cross-sections are staged: everything is ranked once."""
    found = staged(cross_sections(panel, families, alone, names, rets, ["date"], n, min_names), "cross-sections")
    side = lambda k, c: F.struct(F.lit(k).alias("fractile"), F.col(c).alias("who"))
    sides = found.select("place", "date", F.inline(F.array(side(1, "highest"), side(n, "lowest"))))
    sums = sides.select("place", "fractile", "date", F.size("who").alias("__n")).where("__n > 0")
    outer = sides.select("place", "fractile", "date", F.explode("who").alias("symbol"))
    of = lambda k: F.max(F.when(F.col("fractile") == k, F.col("turnover")))
    turn = fractile_turnover(outer, sums, ["place"]).groupBy("place").agg(of(1).alias("turn_top"), of(n).alias("turn_bot"))
    aggs = []
    for i in range(len(rets)):
        ic = f"ic{i}"
        aggs += [F.avg(ic).alias(f"mean{i}"), (ratio(F.avg(ic), F.stddev_samp(ic)) * F.sqrt(F.count(ic))).alias(f"t{i}")]
        aggs += [F.avg(F.when(F.col(ic) > 0, 1.0).when(F.col(ic).isNotNull(), 0.0)).alias(f"hit{i}")]
    legs = found.select("place", *(f"ic{i}" for i in range(len(rets))), *((F.col(k) - F.col("all")).alias(k) for k in ("top", "bot")), (F.col("top") - F.col("bot")).alias("ls"))
    return legs.groupBy("place").agg(*aggs, *active_stats(per_year)).join(turn, "place", "left")
