"""Quality classifier: a generalised additive model with pairwise interactions.

Measures of the whole text are cut into bins at training quantiles. Boosting goes round the features: each step fits a
shallow tree (two levels of splits over the feature's bins) to the gradient and adds its leaves to that feature's
lookup table. Then the pairs of features with the largest gain on what is left get two-dimensional tables, boosted by
trees of one cut each way. A score is the logistic function of a sum of looked-up values, for all rows of a batch at
once.

Training takes labelled rows that aren't held out (crc32 of doc_id as text mod 5 is not 0), a sample of at most about
`max_rows` chosen by a hash of doc_id; measures of all rows are computed once and staged. Result: doc_id, held_out,
score, predicted (1 if score >= 0.3).

Defined cases. Null or empty text: measures of an empty text, scored like any other. A null doc_id is not held out and
not learnt from. A doc_id labelled twice is learnt from twice. Only one label value, or none: its rate (0.5 without
labels). Repeated rows are scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MEASURES = ("log_words", "word_len", "symbols", "pipes", "stops", "upper", "digits", "distinct", "dup_lines", "short_words", "longest", "line_len", "non_ascii", "top_word", "distinct_pairs", "first_upper")
MAX_ROWS, BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE, CUTOFF = 40_000, 32, 12, 6, 150, 40, 0.1, 5.0, 0.3
_SYMBOLS, _STOPS, _UPPER, _DIGITS, _ASCII = b"#*$%&<>{}[]=+~^_\\@", b".!?,;:", bytes(range(65, 91)), b"0123456789", bytes(range(128))


def measures(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    n, size = len(words), max(len(b), 1)
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / size
    if not n:
        return [0.0] * len(MEASURES)
    sizes = list(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(sizes) / n, share(_SYMBOLS), share(b"|"), share(_STOPS), share(_UPPER), share(_DIGITS), len(counts) / n,
        1 - len(set(lines)) / len(lines), sum(s <= 3 for s in sizes) / n, float(max(sizes)), len(b) / len(lines), 1 - share(_ASCII), max(counts.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1), sum(x.lstrip()[:1].isupper() for x in lines) / len(lines),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x (the measures) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [v for t in b.column(1).to_pylist() for v in measures(t)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(MEASURES)), pa.array(x, pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of bins with gradient and curvature sums."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


class Gam:
    """The lookup tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.flat = float(y.mean()) if len(y) else 0.5
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(y) == 0 or y.min() == y.max():
            return
        n_features = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(n_features)]
        self.base = float(np.log(self.flat / (1 - self.flat)))
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        sums = np.full(len(y), self.base)
        tables = [np.zeros(len(e) + 1) for e in self.edges]
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                g, h = self._bent(sums, y)
                step = self._tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
                tables[j] += step
                sums += step[b]
        wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        shape = [len(e) + 1 for e in self.coarse]
        g, h = self._bent(sums, y)
        gains = []
        for i, j in itertools.combinations(range(n_features), 2):
            at = wide[i] * shape[j] + wide[j]
            gains.append((self._quarter(np.bincount(at, g, shape[i] * shape[j]).reshape(shape[i], -1), np.bincount(at, h, shape[i] * shape[j]).reshape(shape[i], -1))[0], i, j))
        pairs = [(i, j, np.zeros((shape[i], shape[j]))) for gain, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in pairs:
                g, h = self._bent(sums, y)
                at = wide[i] * shape[j] + wide[j]
                step = self._quarter(np.bincount(at, g, t.size).reshape(t.shape), np.bincount(at, h, t.size).reshape(t.shape))[1]
                t += step
                sums += step.ravel()[at]
        self.tables, self.pairs = tables, pairs

    @staticmethod
    def _bent(sums: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-sums))
        return y - p, p * (1 - p)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out, cuts = np.zeros(len(g)), {0, len(g)}
        gain, k = _best_cut(g, h)
        if gain > 0:
            cuts |= {k}
            for lo, hi in ((0, k), (k, len(g))):
                gain, c = _best_cut(g[lo:hi], h[lo:hi])
                cuts |= {lo + c} if gain > 0 else set()
        ordered = sorted(cuts)
        for lo, hi in itertools.pairwise(ordered):
            out[lo:hi] = RATE * g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
        return out

    @staticmethod
    def _quarter(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """(gain, step) of the best cut of each axis into four leaves."""
        best, step = 0.0, np.zeros_like(g)
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        if min(g.shape) < 2:
            return best, step
        all_g, all_h = cg[-1, -1], ch[-1, -1]
        a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
        b_g, b_h = cg[:-1, -1:] - a_g, ch[:-1, -1:] - a_h
        c_g, c_h = cg[-1:, :-1] - a_g, ch[-1:, :-1] - a_h
        d_g, d_h = all_g - a_g - b_g - c_g, all_h - a_h - b_h - c_h
        gain = sum(x**2 / (np.maximum(w, 0) + RIDGE) for x, w in ((a_g, a_h), (b_g, b_h), (c_g, c_h), (d_g, d_h))) - all_g**2 / (all_h + RIDGE)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        for rows, cols, x, w in ((slice(0, i + 1), slice(0, j + 1), a_g, a_h), (slice(0, i + 1), slice(j + 1, None), b_g, b_h), (slice(i + 1, None), slice(0, j + 1), c_g, c_h), (slice(i + 1, None), slice(j + 1, None), d_g, d_h)):
            step[rows, cols] = RATE * x[i, j] / (max(w[i, j], 0) + RIDGE)
        return float(gain[i, j]), step

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.full(len(x), self.flat)
        sums = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            sums += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        for i, j, t in self.pairs:
            sums += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-sums))


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def fit(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """Learn from measured rows (doc_id, x) and labels (doc_id, quality): distinct ones, so that repeated rows count once, and
    of these at most max_rows, those of least hash."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_remainder() != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    share = min(1.0, max_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # The sample's ids and labels are broadcast (max_rows bounds them), so measured rows stay where they are.
    found = rows.join(F.broadcast(known), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), "x").distinct()
    got = found.orderBy(F.xxhash64("doc_id", "y", "x")).limit(max_rows).toArrow().combine_chunks()  # tasks keep max_rows each
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(MEASURES))
    y, ids = got.column("y").to_numpy(), got.column("doc_id").to_numpy()
    order = np.lexsort((*x.T[::-1], y, ids))
    return Gam(x[order], y[order])


def score(rows: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted of measured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(MEASURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    found = rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(measured(table(spark, sf_dir, "documents")), "quality-x")
    return score(rows, fit(rows, table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
