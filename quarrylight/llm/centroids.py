"""Centroid clustering of whole-number vectors, with centroids filtered by their n-simplex projection.

The start vectors are also the pivots.  A vector's distances to the pivots are taken once; they fix the place of an
apex over the simplex that the pivots span, up to the side of its base, and that place (as many numbers as there are pivots) is
kept with the vector.  Of two apexes on the same side the distance is a lower bound of the distance of their vectors, on
opposite sides an upper one.  In each round the centroids get their apexes too, and a vector is compared in whole numbers
only with the centroids whose lower bound doesn't pass the smallest upper bound.

A round reads the kept table once; each task sends one sum for each cluster and component, Spark adds them up, and the driver gets
``k`` centroids and no rows of the table.

Vectors are whole numbers and all that decides is exact: distances below 2**62 are computed in 64 bits, larger ones in Python's
integers; sums are decimals of 38 digits.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite one take no part;
components outside 64 bits, and distances and sums of them on output, are held at the bounds of 64 bits; ties go to the centroid with the smaller number;
empty clusters keep their centroid; rows that repeat an id or a whole row are vectors each by itself; a null id is
clustered but never starts a cluster before any other; fewer vectors than clusters give fewer clusters; an empty table gives no
rows; other columns don't reach the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, own_columns

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: Components below this keep 64 squares within 64 bits.
NARROW = 2**27
LARGEST = 2**63 - 1


def quantized(embedding: Column, scale: int = SCALE, dimensions: int = DIMENSIONS) -> Column:
    """floor(scale * x) of each component as bigint; null if the vector can't take part."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) == dimensions) & finite, F.transform(values, lambda x: F.floor(x * scale).cast("bigint")))


def _squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances, in 64 bits where they fit, else Python integers."""
    if max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)), int(np.abs(point.astype(object)).max(initial=0))) >= NARROW:
        away = vectors.astype(object) - point.astype(object)
        return (away * away).sum(axis=1)
    away = vectors - point
    return np.einsum("ij,ij->i", away, away)


class Simplex:
    """Pivots, and the base simplex that they span."""

    def __init__(self, pivots: np.ndarray):
        # Of each pivot, what its edge from the first one adds beyond the space of those before; pivots that add under a tenth of it are left out, which keeps rounding small.
        edges, base, chosen = (pivots - pivots[0].astype(object)).astype(np.float64), [], [0]
        for i in range(1, len(pivots)):
            rest = edges[i].copy()
            for _ in range(2):
                for b in base:
                    rest -= (rest @ b) * b
            if np.sqrt(rest @ rest) > 0.1 * np.sqrt(edges[i] @ edges[i]) > 0:
                base.append(rest / np.sqrt(rest @ rest))
                chosen.append(i)
        self.pivots = pivots[chosen]
        size = len(chosen) - 1
        self.corners = np.array([[edges[c] @ b for b in base] for c in chosen[1:]]).reshape(size, size)  # lower triangular

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """The place of each vector's apex, from its distances to the pivots alone: along the base, and above it."""
        squares = np.stack([_squares(vectors, p).astype(np.float64) for p in self.pivots], axis=1)
        size = len(self.corners)
        out = np.zeros((len(vectors), size + 1))
        right = (squares[:, :1] + (self.corners**2).sum(axis=1) - squares[:, 1:]) / 2
        for i in range(size):
            out[:, i] = (right[:, i] - out[:, :i] @ self.corners[i, :i]) / self.corners[i, i]
        out[:, size] = np.sqrt(np.maximum(0, squares[:, 0] - (out[:, :size] ** 2).sum(axis=1)))
        return out


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its nearest centroid (the first of equals) and the exact squared distance; and how many distances were computed."""
    lower = ((apexes[:, None, :] - centroid_apexes[None, :, :]) ** 2).sum(axis=2)
    upper = lower + 4 * apexes[:, -1:] * centroid_apexes[:, -1]
    # A little wider than the bounds, so that rounding can't leave out a centroid.
    slack = 1e-6 * (1 + (apexes**2).sum(axis=1) + (centroid_apexes**2).sum(axis=1).max())
    open_ = lower <= (upper.min(axis=1) + slack)[:, None]
    best, cluster = np.full(len(vectors), -1, dtype=object), np.zeros(len(vectors), dtype=np.int64)
    exact = np.full((len(vectors), len(centroids)), -1, dtype=object)
    wide = False
    narrow = np.full((len(vectors), len(centroids)), LARGEST, dtype=np.int64)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, j])
        if len(rows):
            squares = _squares(vectors[rows], c)
            wide |= squares.dtype == object
            if squares.dtype == object:
                exact[rows, j] = squares
            else:
                narrow[rows, j] = squares
    if not wide:
        cluster = narrow.argmin(axis=1)
        return cluster, narrow[np.arange(len(vectors)), cluster], int(open_.sum())
    for i in range(len(vectors)):
        found = [(int(exact[i, j]) if exact[i, j] != -1 else int(narrow[i, j]), j) for j in np.flatnonzero(open_[i])]
        best[i], cluster[i] = min(found)
    return cluster, best, int(open_.sum())


def _lists(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def clustered(
    frame: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "vector",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    seed: int = 3,
) -> DataFrame:
    """Each vector's cluster: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    ``vector`` is an array of bigint.  The first centroids are the vectors with the smallest SHA-256 of ``seed:vec_id``.
    """
    scratch = Scratch(frame.sparkSession, "centroids")
    rows = own_columns(frame, vec_id=vec_id, vector=vector).where((F.size("vector") == dimensions) & F.col("vector").isNotNull())
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(place.asc_nulls_last(), F.asc_nulls_last("vec_id"), "vector").limit(clusters).select("vector").collect()
    result = "vec_id long, cluster int, distance long"
    if not start:
        return frame.sparkSession.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["vector"] for r in start], dtype=np.int64)
    simplex = Simplex(centroids)
    width = len(simplex.pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(_lists(batch.column(1), np.int64, dimensions))
            offsets = pa.array(np.arange(0, apexes.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(apexes.reshape(-1)))], ["vec_id", "vector", "apex"])

    kept = scratch.keep(rows.mapInArrow(project, "vec_id long, vector array<long>, apex array<double>"), "vectors")

    def totals(now: np.ndarray):
        above = simplex.apexes(now)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, sizes = np.zeros((len(now), dimensions), dtype=object), np.zeros(len(now), dtype=np.int64)
            for batch in batches:
                vectors = _lists(batch.column(0), np.int64, dimensions)
                cluster, _, _ = nearest(vectors, _lists(batch.column(1), np.float64, width), now, above)
                wide = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0))) >= NARROW
                for j in np.unique(cluster):
                    own = vectors[cluster == j]
                    sums[j] = sums[j] + (own.astype(object) if wide else own).sum(axis=0).astype(object)
                    sizes[j] += len(own)
            used = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, dimensions), pa.int32()),
                    pa.array(np.tile(np.arange(dimensions), len(used)), pa.int32()),
                    pa.array([Decimal(int(x)) for x in sums[used].reshape(-1)], pa.decimal128(38, 0)),
                    pa.array(np.repeat(sizes[used], dimensions), pa.int64()),
                ],
                ["cluster", "i", "total", "n"],
            )

        return add

    for _ in range(rounds):
        sums = kept.select("vector", "apex").mapInArrow(totals(centroids), "cluster int, i int, total decimal(38,0), n long")
        centroids = centroids.copy()
        for r in sums.groupBy("cluster", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # clusters x dimensions rows
            centroids[r["cluster"], r["i"]] = int(r["total"]) // r["n"]

    last, above = centroids, simplex.apexes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(_lists(batch.column(1), np.int64, dimensions), _lists(batch.column(2), np.float64, width), last, above)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array([min(int(d), LARGEST) for d in distance] if distance.dtype == object else distance, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = scratch.keep(kept.mapInArrow(assign, result), "assigned")
    scratch.drop("vectors")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row for each cluster
    named = [(j, min(LARGEST, t), min(LARGEST, sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, t in sorted(inertia.items())]
    if not named:
        return frame.sparkSession.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    of_cluster = frame.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
