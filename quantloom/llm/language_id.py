"""Language ID by nearest centroid.

A text becomes a TF-IDF vector of hashed character 1- to 3-grams (letters lower-cased, everything else one blank),
with 1 + log(tf), of length 1. Each language has several centroids (spherical k-means over its training vectors). A
text goes to the language of the centroid with the largest cosine. Distance-based rejection: `rejected` is true if
that cosine is below a share of a low quantile of the cosines seen in training for texts of that length class (powers
of two of letters). Short classes are filled with cuts of 8 to 256 characters of the training texts, so that short
texts have a floor as well. A text without letters is `und` and rejected.

Training takes, of each language, the k distinct texts of least hash among the labelled rows that have letters: k is
`per_language`, or less where `max_sample` texts in all would be passed, but one at least. So repeated rows count once, the
choice is the same everywhere, it is bounded exactly, and no language is left out. Tasks keep k hashes a language, so
only these are shuffled. Texts stay on the executors: the sample is a staged table, its gram counts are taken in tasks,
document frequencies are a Spark sum, each language's clusters are fitted in a task of its own (at most k sparse rows),
and the floors are aggregates. The driver gets the
frequencies (`dim` numbers), the centroids (`clusters` vectors of `dim` floats a language) and a floor for each length
class. Prediction takes every row and every character, long texts in slices.

Every non-null lang with a text that has letters is learnt (a null doc_id's row is not learnt from). Above `MAX_LANGUAGES` of them `fit` raises ValueError: a
column with so many values holds no languages, and none is left out silently.

Result: doc_id, held_out (crc32 of doc_id as text mod 3 is 1; a null id is not), lang_pred, score (softmax share of the
language), rejected. Ties of cosines: the language first in the alphabet. No labelled rows: all `und`. Repeated rows
are predicted one by one. An empty table gives no rows. Other columns, whatever their names, are ignored by `predict`
and passed through by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

DIM, CLUSTERS, PER_LANGUAGE, MAX_SAMPLE, SHARPNESS, SLICE, MAX_LANGUAGES = 4096, 4, 1500, 6000, 25.0, 1 << 20, 2000
#: A text is rejected below REJECT_SHARE times the LOW quantile of its length class, of at least LEAST training texts.
REJECT_SHARE, LOW, LEAST = 0.6, 0.01, 20
CUTS = (8, 16, 32, 64, 128, 256)
UND = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else a blank."""
    if not _TABLE:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(out)
    return _TABLE[0]


def grams(text: str | None, dim: int = DIM) -> tuple[np.ndarray, int]:
    """(counts of hashed grams, letters) of a whole text."""
    counts, letters, low = np.zeros(dim, np.float32), 0, _letters()
    shift = np.uint64(64 - (dim.bit_length() - 1))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    text = text or ""
    for lo in range(0, len(text), SLICE):
        x = low[np.frombuffer(text[lo : lo + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = x == 32
        letters += len(x) - int(blank.sum())
        x = x[~(blank & np.append(False, blank[:-1]))].astype(np.uint64)
        one = (x + np.uint64(1)) * a
        for n, key in enumerate((one, one[:-1] + x[1:] * b, (one[:-2] + x[1:-1] * b + x[2:] * c) if len(x) > 2 else one[:0])):
            if len(key):
                key = (key ^ (key >> np.uint64(29))) * c + np.uint64(n)
                counts += np.bincount(((key * a) >> shift).astype(np.int64), minlength=dim)
    return counts, letters


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of rows of counts, which they replace."""
    some = counts > 0
    v = np.log(np.maximum(counts, 1, out=counts), out=counts)
    v += some
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return v


def _centroids(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; begun at the mean's nearest vector, then each time at the farthest."""
    chosen = [int(np.argmax(v @ v.mean(0)))]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin((v @ v[chosen].T).max(1))))
    c = v[chosen].copy()
    for _ in range(rounds):
        at = np.argmax(v @ c.T, 1)
        for j in range(len(c)):
            if (at == j).any():
                m = v[at == j].mean(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


class Model:
    """Centroids by language, idf of the grams and the floors of the length classes."""

    def __init__(self, langs: list[str], idf: np.ndarray, each: list[np.ndarray], dim: int = DIM) -> None:
        """langs: sorted; each: the centroids of each."""
        self.langs, self.idf, self.dim, self.floor = langs, idf, dim, np.zeros(64)
        if langs:
            self.centroids = np.concatenate(each)
            self.owner = np.repeat(np.arange(len(each)), [len(x) for x in each])

    def nearest(self, found: list[np.ndarray]) -> np.ndarray:
        """The best cosine with each language of rows of gram counts."""
        return self._by_language(vectors(np.stack(found), self.idf) @ self.centroids.T)

    def _by_language(self, cosines: np.ndarray) -> np.ndarray:
        return np.stack([cosines[:, self.owner == k].max(1) for k in range(len(self.langs))], 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if not self.langs:
            return [(UND, 0.0, True)] * len(texts)
        found = [grams(t, self.dim) for t in texts]
        cos = self.nearest([g for g, _ in found]) if found else []
        out = []
        for c, (_, letters) in zip(cos, found, strict=True):
            k = int(c.argmax())
            e = np.exp(SHARPNESS * (c - c[k]))
            out.append((self.langs[k], float(1 / e.sum()), bool(c[k] < self.floor[int(np.log2(letters + 1))])) if letters else (UND, 0.0, True))
        return out


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def _least(rows: DataFrame, k: int) -> DataFrame:
    """(lang, key): the k least distinct keys of each language of rows (lang, key); tasks keep k a language first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            coded = b.column(0).dictionary_encode()
            codes, keys = coded.indices.to_numpy(), b.column(1).to_numpy()
            for c, lang in enumerate(coded.dictionary.to_pylist()):
                mine = keys[codes == c]
                held[lang] = np.unique(np.concatenate([held[lang], mine]) if lang in held else mine)[:k]
        for lang, keys in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys)], names=["lang", "key"])

    w = Window.partitionBy("lang").orderBy("key")
    found = rows.mapInArrow(run, "lang string, key long").distinct()
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _sample(docs: DataFrame, per_language: int, max_sample: int) -> DataFrame:
    """lang, key, text of the training texts, staged."""
    # Code points that the JVM doesn't know may be letters of a newer alphabet.
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"[\p{L}\p{Cn}]") & (_remainder(3) != 1))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"), "text")
    languages = labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    k = min(per_language, max(max_sample // max(languages, 1), 1))
    chosen = staged(_least(labelled.select("lang", "key"), k), "language-keys")
    rows = labelled.join(F.broadcast(chosen), ["lang", "key"])  # at most max_sample rows, or one for each of MAX_LANGUAGES
    return staged(rows.groupBy("lang", "key").agg(F.min("text").alias("text")), "language-sample")


def _counted(sample: DataFrame, dim: int) -> DataFrame:
    """lang, key, dims, counts: the grams of each sampled text with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, dims, counts = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                g, letters = grams(text, dim)
                if letters:
                    keep.append(i)
                    dims.append(np.flatnonzero(g).astype(np.int32))
                    counts.append(g[dims[-1]])
            if keep:
                lists = [pa.array(x, pa.list_(t)) for x, t in ((dims, pa.int32()), (counts, pa.float32()))]
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *lists], names=["lang", "key", "dims", "counts"])

    return sample.select("lang", "key", "text").mapInArrow(run, "lang string, key long, dims array<int>, counts array<float>")


def _clustered(counted: DataFrame, idf: np.ndarray, clusters: int, dim: int) -> DataFrame:
    """lang, k, centroid: each language's clusters, fitted in one task over its sampled rows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key").combine_chunks()
        counts = np.zeros((rows.num_rows, dim), np.float32)
        for i, (d, c) in enumerate(zip(rows.column("dims"), rows.column("counts"), strict=True)):
            counts[i, d.values.to_numpy()] = c.values.to_numpy()
        found = _centroids(vectors(counts, idf), clusters)
        return pa.table({"lang": [rows.column("lang")[0].as_py()] * len(found), "k": pa.array(range(len(found)), pa.int32()), "centroid": pa.array(list(found), pa.list_(pa.float32()))})

    return counted.groupBy("lang").applyInArrow(run, "lang string, k int, centroid array<float>")


def _floors(sample: DataFrame, model: Model) -> np.ndarray:
    """The floor of each length class; a class with too few training texts takes that of the next shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 32):
                part, sizes, right, found = b.slice(lo, 32), [], [], []
                for lang, text, key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    cuts = [(key % (len(text) - n), n) for n in CUTS if n < len(text)]
                    for piece in (text, *(text[a : a + n] for a, n in cuts)):
                        g, letters = grams(piece, model.dim)
                        if letters:
                            found.append(g)
                            sizes.append(int(np.log2(letters + 1)))
                            right.append(model.langs.index(lang))
                if found:
                    cos = model.nearest(found)
                    hit = np.flatnonzero(cos.argmax(1) == np.array(right))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(sizes, np.int32)[hit]), pa.array(cos.max(1).astype(np.float64)[hit])], names=["size", "cos"])

    rows = sample.select("lang", "text", F.pmod("key", F.lit(1 << 30)).alias("key")).mapInArrow(run, "size int, cos double")
    least = {r["size"]: r["q"] for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.percentile("cos", F.lit(LOW)).alias("q")).where(F.col("n") >= LEAST).collect()}
    out, last = np.zeros(64), 0.0
    for s in range(64):
        out[s] = last = REJECT_SHARE * least[s] if s in least else last
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_sample: int = MAX_SAMPLE, dim: int = DIM, clusters: int = CLUSTERS) -> Model:
    """Learn from text and lang of docs that aren't held out."""
    sample = _sample(docs, per_language, max_sample)
    counted = staged(_counted(sample, dim), "language-grams")
    idf = np.full(dim, np.log(1 + counted.count()) + 1)
    for r in counted.select(F.explode("dims").alias("d")).groupBy("d").agg(F.count("*").alias("df")).collect():  # at most dim rows
        idf[r["d"]] -= np.log(1 + r["df"])
    idf = idf.astype(np.float32)
    each: dict[str, list[np.ndarray]] = {}
    for r in _clustered(counted, idf, clusters, dim).orderBy("lang", "k").toArrow().to_batches():
        for lang, centroid in zip(r.column(0).to_pylist(), r.column(2), strict=True):
            each.setdefault(lang, []).append(centroid.values.to_numpy().astype(np.float32))
    langs = sorted(each)
    model = Model(langs, idf, [np.stack(each[k]) for k in langs], dim)
    if langs:
        model.floor = _floors(sample, model)
    return model


def _with_predictions(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns by position (c0, c1, ...), then lang_pred, score and rejected (Arrow batches)."""
    from pyspark.sql import types as T

    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    out = [*names, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                p = model.predict(part.column(at).to_pylist())
                more = [pa.array([x[k] for x in p], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=out)

    types = [*(f.dataType for f in docs.schema.fields), T.StringType(), T.DoubleType(), T.BooleanType()]
    return docs.toDF(*names).mapInArrow(run, T.StructType(list(map(T.StructField, out, types))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of docs (doc_id, text)."""
    found = _with_predictions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).withColumnRenamed("c0", "doc_id")
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected, with docs' columns."""
    found = _with_predictions(docs, model).where("not rejected")
    return found.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
