"""Least squares for every key at once, of any rank.

Rows are reduced to the sums of a Gram matrix by (keys, group), with partial sums in the tasks that read them, so neither a
key with very many rows nor the number of keys matters; a row a key goes to the solver. That works on stacks of small
matrices: eigenvalues of the Gram matrix with unit diagonal say which directions have data (relative to its size, at least
`RANK`), and of all solutions the one of least norm in the given units is taken, as lstsq gives it. A constant or repeated
regressor, or one that the group dummies span, is therefore no special case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import complete

RANK, MAX_GROUPS = 1e-10, 1000


def solve(gram: np.ndarray, moment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, rank) of least norm for stacks of X'X (k, p, p) and X'y (k, p)."""
    scale = np.sqrt(np.einsum("kii->ki", gram))
    scale = np.where(scale > 0, scale, 1.0)
    value, vector = np.linalg.eigh(gram / (scale[:, :, None] * scale[:, None, :]))
    real = value > RANK * gram.shape[1]
    inverse = np.where(real, 1 / np.where(real, value, 1.0), 0.0)
    b = np.einsum("kpi,ki,kqi,kq->kp", vector, inverse, vector, moment / scale) / scale
    short = np.flatnonzero(~real.all(1))
    if len(short):  # leave out what lies in directions without data
        none = np.where(real[short][:, None, :], 0.0, vector[short]) / scale[short][:, :, None]
        b[short] -= np.einsum("kpi,kiq,kq->kp", none, np.linalg.pinv(none), b[short])
    return b, real.sum(1)


def fits(df: DataFrame, y: str, x: list[str], keys: list[str], group: str | None, models: dict[str, tuple[list[str], bool]], min_obs: int = 30) -> DataFrame:
    """keys, n and, for each model name -> (regressors, with dummies of group), its coefficients as an array and its rank
    (`<name>_rank`), over the rows complete in y, x and group. Every model has an intercept; dummies are those of the groups
    a key has, but the first. Keys with fewer than min_obs rows are left out."""
    rows = df.where(complete(y, *x, *([group] if group else [])))
    s = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b).cast("double"))
    square = F.array(*(s(a, b) for i, a in enumerate(x) for b in x[i:])) if x else F.array().cast("array<double>")
    cell = rows.groupBy(*keys, *([group] if group else [])).agg(
        F.count("*").alias("__n"), F.sum(F.col(y).cast("double")).alias("__y"), F.array(*(F.sum(F.col(c).cast("double")) for c in x)).cast("array<double>").alias("__x"),
        square.alias("__xx"), F.array(*(s(c, y) for c in x)).cast("array<double>").alias("__xy"),
    )
    label = F.col(group).cast("string") if group else F.lit("")
    whole = cell.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sort_array(F.collect_list(F.struct(label.alias("g"), "__n", "__y", "__x", "__xx", "__xy"))).alias("cells"))
    many = F.raise_error(F.lit(f"more than {MAX_GROUPS} groups in a key"))
    whole = whole.where(F.col("n") >= min_obs).withColumn("cells", F.when(F.size("cells") <= MAX_GROUPS, F.col("cells")).otherwise(many))
    upper = np.triu_indices(len(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(b.num_columns - 1).to_pylist()
            results = {name: ([None] * len(cells), [None] * len(cells)) for name in models}
            by_size: dict[int, list[int]] = {}
            for i, c in enumerate(cells):
                by_size.setdefault(len(c), []).append(i)
            for size, at in by_size.items():
                take = lambda f: np.array([[c[f] for c in cells[i]] for i in at], float)  # noqa: B023, E731
                n, sy, sx, xy = take("__n"), take("__y"), take("__x").reshape(len(at), size, len(x)), take("__xy").reshape(len(at), size, len(x))
                xx = np.zeros((len(at), len(x), len(x)))
                xx[:, upper[0], upper[1]] = take("__xx").reshape(len(at), size, -1).sum(1)
                xx[:, upper[1], upper[0]] = xx[:, upper[0], upper[1]]
                for name, (columns, grouped) in models.items():
                    c = [x.index(k) for k in columns]
                    dummies, m = range(1, size) if grouped else (), len(columns)
                    p = 1 + m + len(dummies)
                    gram, moment = np.zeros((len(at), p, p)), np.zeros((len(at), p))
                    gram[:, 0, 0], moment[:, 0] = n.sum(1), sy.sum(1)
                    gram[:, 0, 1 : m + 1] = gram[:, 1 : m + 1, 0] = sx.sum(1)[:, c]
                    gram[:, 1 : m + 1, 1 : m + 1] = xx[:, c][:, :, c]
                    moment[:, 1 : m + 1] = xy.sum(1)[:, c]
                    for j, d in enumerate(dummies, m + 1):
                        gram[:, j, j] = gram[:, 0, j] = gram[:, j, 0] = n[:, d]
                        gram[:, j, 1 : m + 1] = gram[:, 1 : m + 1, j] = sx[:, d][:, c]
                        moment[:, j] = sy[:, d]
                    found, rank = solve(gram, moment)
                    for i, k in enumerate(at):
                        results[name][0][k], results[name][1][k] = found[i, 1 : m + 1].tolist(), int(rank[i])
            more = [pa.array(v, t) for found, rank in results.values() for v, t in ((found, pa.list_(pa.float64())), (rank, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=names)

    names = [*keys, "n", *(c for name in models for c in (name, f"{name}_rank"))]
    kinds = [T.ArrayType(T.DoubleType()), T.IntegerType()] * len(models)
    fields = [*whole.schema.fields[:-1], *(T.StructField(c, k) for c, k in zip(names[len(keys) + 1 :], kinds, strict=True))]
    return whole.select(*keys, "n", "cells").mapInArrow(run, T.StructType(fields))
