"""Centroid clustering (k-means on integer vectors) by exponion search.

Vectors of exactly `dim` finite components become integers floor(scale * x). The centroids start as the `k` vectors of
least sha256 of `<seed>:<vec_id>`. Each round every vector goes to the nearest centroid (squared distance; ties: the
smaller number), then every centroid that has vectors becomes the floor of their mean; at the end vectors are assigned
once more. Distances and sums are integers, so the result is exact.

A vector carries its centroid a, an upper bound u of its distance to a and a lower bound l of that to any other. Both
are moved by as much as the centroids moved. If u < l, or u is less than half of a's distance to its nearest neighbour,
a is still the nearest. Else u is made exact; then only centroids within 2 u + (distance from a to its nearest
neighbour) of a can be nearest or second, and these are the first ones in the list of centroids sorted by distance from
a. The radius is inclusive and bounds are widened by a relative 1e-12, so that no tie is lost to rounding.

A round is a pass over a staged table (vector, centroid, bounds); the round before it is discarded. Tasks send a sum for
each centroid they have met, the driver holds k centroids. Common vectors are not moved to each other.

Result: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. Defined cases. Null vectors, those
of another length and those with a null, NaN or infinite component have no row. Rows that repeat a vec_id are vectors
of their own; for the start such rows are ordered by their components. A null vec_id starts no cluster unless fewer than
k others are there. Fewer than k vectors: as many clusters. Equal centroids: the smaller number takes all. Components
beyond +-2^27 after scaling raise ValueError, as no squared distance in a long is sure to hold them. Empty table: no
rows. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_folder, staged_in, table

K, DIM, SCALE, ROUNDS, SEED, LIMIT = 8, 64, 1024, 10, "3", 1 << 27
WIDEN = 1e-12
STATE = "vec_id long, x binary, cluster int, upper double, lower double, distance long"
STEP = 4096


class Geometry:
    """Centroids, how far they moved, and for each the others sorted by distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids = centroids
        moved = np.zeros(len(centroids)) if before is None else _root(((centroids - before) ** 2).sum(1)) * (1 + WIDEN)
        self.moved = moved
        self.most_other = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
        squared = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
        # A centroid's own place comes first, before centroids equal to it.
        own = np.arange(len(centroids))
        self.order = np.stack([np.lexsort((own, squared[j], own != j)) for j in own])
        self.apart = _root(np.take_along_axis(squared, self.order, 1))
        self.nearest = self.apart[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry) -> int:
    """Move rows of x to their nearest centroids in place; returns how many distances to other centroids were taken."""
    k = len(g.centroids)
    upper += g.moved[cluster]
    lower -= g.most_other[cluster]
    safe = np.maximum(lower, g.nearest[cluster] / 2 * (1 - WIDEN))
    rows = np.flatnonzero(~(upper < safe))
    own = ((x[rows] - g.centroids[cluster[rows]]) ** 2).sum(1)
    upper[rows] = _root(own) * (1 + WIDEN)
    left = ~(upper[rows] < safe[rows])
    rows, best = rows[left], own[left]
    if not len(rows) or k == 1:
        return 0
    a = cluster[rows]
    radius = (2 * upper[rows] + g.nearest[a]) * (1 + WIDEN)
    inside = np.array([np.searchsorted(g.apart[j], r, "right") for j, r in zip(a, radius, strict=True)])  # a itself is first
    second, found, taken = np.full(len(rows), np.iinfo(np.int64).max), a.copy(), 0
    for place in range(1, k):
        at = np.flatnonzero(inside > place)
        if not len(at):
            break
        taken += len(at)
        j = g.order[a[at], place]
        d = ((x[rows[at]] - g.centroids[j]) ** 2).sum(1)
        nearer = (d < best[at]) | ((d == best[at]) & (j < found[at]))
        second[at] = np.minimum(second[at], np.where(nearer, best[at], d))
        best[at] = np.where(nearer, d, best[at])
        found[at] = np.where(nearer, j, found[at])
    cluster[rows], upper[rows] = found, _root(best) * (1 + WIDEN)
    # Outside the ball nothing is nearer than the second found; without a second the ball holds its neighbour at least.
    lower[rows] = np.where(second == np.iinfo(np.int64).max, 0.0, _root(second) * (1 - WIDEN))
    return taken


def vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, x (int32 components as bytes) and no centroid yet, of embeddings (vec_id, embedding)."""
    good = f"size(embedding) = {dim} and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity'))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy() * scale).reshape(b.num_rows, dim)
            if np.abs(x).max(initial=0) > LIMIT:
                raise ValueError(f"components beyond {LIMIT} after scaling")
            yield _state(b.column(0), x.astype(np.int32), np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.inf), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64))

    return rows.mapInArrow(run, STATE)


def _state(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    n, width = x.shape
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 4 * width * (n + 1), 4 * width, np.int32)), pa.py_buffer(x.tobytes())])
    return pa.RecordBatch.from_arrays([ids, packed, *(pa.array(c) for c in (cluster, upper, lower, distance))], names=[f.split()[0] for f in STATE.split(", ")])


def _components(b: pa.Array, width: int) -> np.ndarray:
    ends = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(b.buffers()[2], np.int32)[ends[0] // 4 : ends[-1] // 4].reshape(len(b), width)


def _moved(state: DataFrame, g: Geometry, last: bool) -> DataFrame:
    """The state after an assignment; last: with exact distances."""
    width = g.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                b = whole.slice(lo, STEP)
                x = _components(b.column(1), width)
                cluster, upper, lower = (np.array(b.column(c).to_numpy()) for c in (2, 3, 4))
                wide = x.astype(np.int64)
                assign(wide, cluster, upper, lower, g)
                distance = ((wide - g.centroids[cluster]) ** 2).sum(1) if last else np.zeros(len(x), np.int64)
                yield _state(b.column(0), x, cluster, upper, lower, distance)

    return state.mapInArrow(run, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' means; those without vectors stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                b = whole.slice(lo, STEP)
                x, cluster = _components(b.column(1), width), b.column(0).to_numpy()
                n += np.bincount(cluster, minlength=k)
                for j in np.unique(cluster):
                    sums[j] += x[cluster == j].sum(0, dtype=np.int64)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in parts.collect():  # k * dim rows
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def starts(state: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The components of the k vectors of least hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = state.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], np.int32) for r in rows], np.int64)


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of embeddings (vec_id, embedding)."""
    spark, last = embeddings.sparkSession, new_folder(embeddings.sparkSession, "clusters")
    state = staged_in(vectors(embeddings, dim, scale), last)
    centroids, before = starts(state, k, seed), None
    if len(centroids):
        for done in range(rounds + 1):
            path = new_folder(spark, "clusters")
            state = staged_in(_moved(state, Geometry(centroids, before), done == rounds), path)
            discard(spark, last)
            last = path
            if done < rounds:
                before, centroids = centroids, _means(state, centroids)
    sums = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    rows = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j in sorted(sums)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster")  # k rows
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """SQL of the assignment to the centroids c{i} and of their successors."""
    return f"""
a{i} as materialized (select vec_id, n, k, d from (select vec_id, v.n, k, d, row_number() over (partition by v.n order by d, k) as r
  from (select p.vec_id, p.n, c.k, sum((p.x - c.x) * (p.x - c.x)) as d from p join c{i} c on p.i = c.i group by p.vec_id, p.n, c.k) v) where r = 1),
m{i} as (select k, i, (s - ((s % n + n) % n)) // n as x from (select a.k, p.i, sum(p.x) as s, count(*) as n from a{i} a join p on p.n = a.n group by a.k, p.i)),
c{i + 1} as materialized (select c.k, c.i, coalesce(m.x, c.x) as x from c{i} c left join m{i} m on m.k = c.k and m.i = c.i),"""


ORACLE = f"""
with e as (select row_number() over () as n, vec_id, embedding from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}),
p as materialized (select vec_id, n, i, cast(floor({SCALE} * cast(embedding[i] as double)) as bigint) as x from (select vec_id, n, embedding, unnest(range(1, {DIM + 1})) as i from e)),
h as (select n, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as k from e),
c0 as materialized (select h.k, p.i, p.x from h join p on p.n = h.n where h.k < {K}),{''.join(map(_round, range(ROUNDS + 1)))}
z as (select k, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{ROUNDS} group by k)
select vec_id, cast(k as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  centroid_sha256 from a{ROUNDS} join z using (k)
"""
QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLES = {"op12_centroid_clusters": ORACLE}
