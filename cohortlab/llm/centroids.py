"""Centroid clustering of integer vectors; the nearest centroid is found by a tournament of bisector tests.

For centroids a < b a vector x lies no farther from a than from b if x . 2(a - b) >= |a|^2 - |b|^2. The normals 2(a - b) and the
thresholds |a|^2 - |b|^2 of all pairs are computed once a round. A vector's champion starts as centroid 0 and meets centroids 1 to k - 1 in turn:
one sign test each, and zero leaves the champion, whose number is the smaller one. So k - 1 tests name the nearest centroid with ties to
the smaller number, all in integers; the distance to it is computed exactly at the end.

A round reads the vectors once. A task passes on one row per centroid (count and componentwise sums), so a round shuffles
tasks x k rows whatever the clusters' sizes, and k rows of totals reach the driver. The final assignment is written to the
shared folder, (id, cluster, distance) alone, and read again with the clusters' totals beside it.

Defined results: vectors that are NULL, of another length, or hold a NULL, NaN or infinite component are left out; a NULL id takes part
and hashes like an empty one; repeated rows count each, and where ids of first centroids tie, the smaller vector goes first; with
fewer vectors than k there are fewer centroids; an empty table gives an empty result. Scaled components beyond LARGEST in
magnitude count as LARGEST: up to there every product and distance is exact in 64 bits. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import cut_lineage

#: Magnitude up to which 64 components keep normals, tests and distances below 2^63.
LARGEST = 1 << 27


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components as floor(scale * x), one row each)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy()
    rows = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(rows)).flatten()
    whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(axis=1)
    x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    keep = whole & np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(x[keep] * scale)
    return rows[keep], np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


class Tournament:
    """Normals and thresholds of all pairs of some centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normals = 2 * (centroids[:, None, :] - centroids[None, :, :])
        self.thresholds = squares[:, None] - squares[None, :]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        champion = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", x, self.normals[champion, j]) - self.thresholds[champion, j]
            champion = np.where(side >= 0, champion, j)
        return champion

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[cluster]
        return (apart * apart).sum(axis=1)


def first_centroids(vectors: DataFrame, id_col: str, vec_col: str, k: int, seed: int, dims: int, scale: float) -> np.ndarray:
    """The k kept vectors whose ids have the smallest hashes, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter((F.size(vec_col) == dims) & fine)
    first = kept.select(F.sha2(name, 256).alias("h"), F.col(vec_col).alias("v")).orderBy("h", "v").limit(k).collect()
    kind = pa.list_(pa.float64())
    return integers(pa.array([list(map(float, r["v"])) for r in first], kind), dims, scale)[1]


def _totals(vectors: DataFrame, vec_col: str, centroids: np.ndarray, scale: float) -> tuple[list[int], list[list[int]]]:
    """Count and componentwise sums of every cluster."""
    k, dims = centroids.shape
    names = ["cluster", "n", *[f"s{d}" for d in range(dims)]]
    tournament = Tournament(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = integers(b.column(0), dims, scale)[1]
            cluster = tournament.nearest(x)
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            held, at = np.unique(cluster[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(x[order], at, axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *[pa.array(sums[some, d]) for d in range(dims)]], names=names)

    partial = vectors.select(F.col(vec_col).alias("_v")).mapInArrow(each, ", ".join(f"{c} bigint" for c in names))
    # totals of many tasks may pass 64 bits
    whole = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names[2:]]).collect()
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    for r in whole:
        counts[r["cluster"]] = r["n"]
        sums[r["cluster"]] = [int(r[c]) for c in names[2:]]
    return counts, sums


def _assigned(vectors: DataFrame, id_col: str, vec_col: str, centroids: np.ndarray, scale: float) -> DataFrame:
    """(_id, cluster, distance) of every kept vector."""
    dims = centroids.shape[1]
    tournament = Tournament(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = integers(b.column(1), dims, scale)
            cluster = tournament.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(tournament.distances(x, cluster))], names=["_id", "cluster", "distance"]
            )

    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")).mapInArrow(each, f"_id {id_type}, cluster int, distance bigint")


def centroids_of(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0
) -> np.ndarray:
    """The centroids after ``rounds`` rounds, one row each; an empty cluster keeps its centroid."""
    now = first_centroids(vectors, id_col, vec_col, k, seed, dims, scale)
    for _ in range(rounds if len(now) else 0):
        counts, sums = _totals(vectors, vec_col, now, scale)
        now = np.array([[s // n for s in own] if n else old for n, own, old in zip(counts, sums, now.tolist(), strict=True)], np.int64)
    return now


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0
) -> DataFrame:
    """(_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    now = centroids_of(vectors, id_col, vec_col, k, rounds, seed, dims, scale)
    if not len(now):
        now = np.zeros((1, dims), np.int64)  # no vector is kept, so no row will use it
    rows = cut_lineage(_assigned(vectors, id_col, vec_col, now, scale))
    within = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    per_cluster = F.array(*[F.lit(within.get(c, 0)).cast("long") for c in range(len(now))])
    return rows.select(
        "_id", "cluster", "distance", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(within.values())).cast("long").alias("inertia"), F.get(F.array(*map(F.lit, names)), F.col("cluster")).alias("centroid_sha256"),
    )
