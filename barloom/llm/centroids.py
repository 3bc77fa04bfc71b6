"""k-means on integer vectors, with centroids filtered by n-simplex projection.

A few pivots span a simplex.  A vector's distances to them, taken once and cached,
place it as the apex over that simplex: all coordinates but the last lie in the
pivots' space, the last is the height over it.  Between two apexes, the distance
with the heights on the same side is a lower bound of the distance of the vectors,
and with the heights on opposite sides an upper bound.  A centroid whose lower
bound exceeds the least upper bound cannot be nearest, nor one whose lower bound exceeds the
distance of the centroid with the least one; those left are compared exactly, in
integers.  The bounds are floating-point numbers, so they are widened by ``_SLACK`` of
the squared norms, far more than their rounding (pivots that lie nearly in the space
of the others are not taken).

Scale: vectors and their apexes are written once; a round reads them, and a task
sends one row of sums per cluster, whatever the number of its vectors.  The driver
holds ``k`` centroids of ``dims`` numbers, and of the vectors those that may be
pivots.  Vectors nearly as far from all centroids, as in many dimensions, need many
pivots for bounds that filter; well separated ones do with few.

Cases: a vector that is null, has not exactly ``dims`` components, or has one that
is null or not finite is left out; a component x is floor(``scale`` * x); fewer than ``k``
vectors are a centroid each; like vectors tie, and the smaller number wins; a null
identifier hashes last, a repeated one is a row of its own, with ties broken by the
components; empty tables give empty results; other columns are not read.  An
integer beyond 2^27 is an error, because distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches, written

_SLACK, _FLAT, _MOST, _CHUNK = 1e-5, 0.02, 1 << 27, 1024


class Simplex:
    """The pivots' simplex, the first pivot in the origin, and apexes over it."""

    def __init__(self, candidates: np.ndarray, n_pivots: int):
        """Pivots in turn the candidate highest over the simplex so far; none that is nearly in its space."""
        self.pivots = candidates[:1]
        self.base = np.zeros((0, 0))
        largest = 0.0
        while len(self.pivots) < n_pivots:
            high = self.apexes(candidates)[:, -1]
            best = int(high.argmax())
            largest = max(largest, high[best])
            if high[best] <= _FLAT * largest or not high[best]:
                break
            own = self.apexes(candidates[best : best + 1])[0]
            self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), own])
            self.pivots = np.vstack([self.pivots, candidates[best]])

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' space, then the height."""
        d = self.distances(vectors).astype(float)
        at = np.zeros((len(vectors), len(self.pivots)))
        for j, row in enumerate(self.base):
            at[:, j] = ((d[:, 0] + row @ row - d[:, j + 1]) / 2 - at[:, :j] @ row[:j]) / row[j]
        at[:, -1] = np.sqrt(np.maximum(0.0, d[:, 0] - (at[:, :-1] ** 2).sum(axis=1)))
        return at


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many pairs were compared exactly."""
    cluster, distance, compared = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64), 0
    top_norm = (tops**2).sum(axis=1)
    for a in range(0, len(vectors), _CHUNK):
        v, at = vectors[a : a + _CHUNK], apexes[a : a + _CHUNK]
        flat = ((at[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
        slack = _SLACK * ((at**2).sum(axis=1)[:, None] + top_norm)
        upper = flat + (at[:, -1:] + tops[:, -1]) ** 2 + slack
        lower = flat + (at[:, -1:] - tops[:, -1]) ** 2 - slack
        exact = np.full(flat.shape, np.iinfo(np.int64).max)

        def compare(i: np.ndarray, k: np.ndarray) -> None:
            gap = v[i] - centroids[k]
            exact[i, k] = np.einsum("ij,ij->i", gap, gap)

        # The most promising one first: its distance often rules out those that the upper bounds leave.
        left = lower <= upper.min(axis=1, keepdims=True)
        own = np.arange(len(v))
        best = lower.argmin(axis=1)
        compare(own, best)
        left &= lower <= exact[own, best][:, None]
        left[own, best] = False
        compare(*np.nonzero(left))
        compared += len(v) + int(left.sum())
        cluster[a : a + len(v)] = exact.argmin(axis=1)  # the first of equals
        distance[a : a + len(v)] = exact.min(axis=1)
    return cluster, distance, compared


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of rows of ``width`` numbers."""
    return np.array([np.frombuffer(x, kind) for x in column.to_pylist()]).reshape(len(column), width)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the whole and finite vectors as integers."""
    x = F.col(vector_col)
    whole = F.coalesce(F.size(x) == dims, F.lit(False)) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(whole).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with smallest sha256 of ``seed:vec_id``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r.v for r in kept.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def centroid_clusters(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    n_pivots: int = 56,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared.

    ``n_compared`` is the number of vector and centroid pairs that the bounds left
    for exact comparison in the last assignment, over all vectors.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = kept_vectors(vectors, dims, scale, id_col, vector_col)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    first = first_centroids(kept, max(k, n_pivots + n_pivots // 4), seed)
    if not first:
        schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared long"
        return spark.createDataFrame([], schema)
    candidates = _bounded(np.array(first, np.int64).reshape(len(first), dims))
    centroids, simplex = candidates[:k], Simplex(candidates, n_pivots)
    width = len(simplex.pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _bounded(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            if len(v):
                yield pa.RecordBatch.from_arrays([batch.column(0), _packed(v.astype("<i4")), _packed(simplex.apexes(v))], ["vec_id", "v", "apex"])

    # Where a vector lies doesn't change from round to round.
    placed = written(kept.mapInArrow(project, f"vec_id {id_type}, v binary, apex binary"), "apexes")

    def assigned(batches: Iterator[pa.RecordBatch], at: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
        tops = simplex.apexes(at)
        for batch in batches:
            v = _matrix(batch.column("v"), "<i4", dims).astype(np.int64)
            yield batch, v, *nearest(v, _matrix(batch.column("apex"), "<f8", width), at, tops)

    def sums_by(at: np.ndarray) -> DataFrame:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(at), dims), np.int64), np.zeros(len(at), np.int64)
            for _, v, cluster, _, _ in assigned(batches, at):
                np.add.at(total, cluster, v)
                n += np.bincount(cluster, minlength=len(at))
            some = np.nonzero(n)[0]
            columns = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

        found = placed.select("v", "apex").mapInArrow(sums, "cluster int, n long, total array<long>")
        wide = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).alias(x)
        return found.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(wide("n"), wide("x"))

    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums_by(centroids).collect():  # k * dims rows
            moved[r.cluster, r.i] = int(r.x) // int(r.n)
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v, cluster, distance, compared in assigned(batches, centroids):
            share = np.zeros(len(v), np.int64)
            share[:1] = compared
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(share)], ["vec_id", "cluster", "distance", "compared"])

    found = written(placed.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long, compared long"), "clusters")
    wide = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    per_cluster = found.groupBy("cluster").agg(wide("distance").alias("own"), wide("compared").alias("compared")).collect()  # k rows
    inertia, compared = sum(int(r.own) for r in per_cluster), sum(int(r.compared) for r in per_cluster)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(r.cluster, int(r.own), inertia, digest(centroids[r.cluster].tolist()), compared) for r in per_cluster]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, n_compared long")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")


def _bounded(v: np.ndarray) -> np.ndarray:
    if v.size and (v.max() > _MOST or v.min() < -_MOST):
        raise ValueError(f"a component beyond {_MOST} after scaling: distances would not fit a long")
    return v
