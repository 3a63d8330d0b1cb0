"""Centroid clustering with exact integer arithmetic and an annulus search (operator 13).

A vector counts as integers floor(256 * x). By the triangle inequality a centroid nearer than a known
distance u has a norm within u of the vector's own norm. So centroids are sorted by norm; the
two with the next norms below and above give each vector an upper bound u; a binary search finds the
centroids in the annulus [norm - u, norm + u], its edges widened by more than the rounding of norms, and these alone are compared exactly.
Candidates at equal distance stay, and the smallest number among them wins, so results are those of comparing all.

Rounds are Spark jobs over the table itself: each task adds up its own vectors by cluster and hands
on one row for each cluster it met; the driver sees k rows of sums and sends k centroids back.
Vectors are never shuffled, written or collected; a lost executor costs its tasks alone.

Starts are the ``k`` kept vectors with the smallest sha256 of ``<seed>:<vec_id>`` (equal hashes: by components).

Defined cases: vectors of another length, or with null, NaN or infinite components, aren't kept, nor null
ones; with fewer than k kept vectors all are starts; an empty table gives no rows; repeated rows count
each; a null vec_id hashes as ``<seed>:`` and stays null; other columns are ignored. Components beyond 2^62 count as
2^62; distances and sums beyond what a long holds are given as the largest long, but compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, LARGEST = 256.0, (1 << 63) - 1
#: Components up to this size give sums below 2^53, which doubles hold exactly.
PLAIN = 1 << 21
BLOCK = 512
ASSIGNED = "vec_id long, cluster int, distance long"


def kept(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of the right length whose components are all there and finite."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).filter((F.size("v") == size) & fine)


def integers(v: pa.ListArray, size: int) -> np.ndarray:
    """(n, size) components as whole doubles; above 2^53 they are those doubles' own values."""
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore"):  # beyond the range of doubles: infinite, so 2^62
        return np.clip(np.floor(flat * SCALE), -float(1 << 62), float(1 << 62))


@dataclass
class Centroids:
    """k integer centroids, sorted by norm for the search."""

    whole: list[list[int]]

    def __post_init__(self) -> None:
        x = np.array([[float(c) for c in row] for row in self.whole])
        norms = np.sqrt((x * x).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.x = norms[self.number], x[self.number]
        self.squares = (self.x * self.x).sum(1)
        self.large = np.abs(self.x).max(1) > PLAIN

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.whole[k])).encode()).hexdigest()

    def _distances(self, x: np.ndarray, at: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Squared distances of all rows to some centroids (positions), in doubles; exact where both are plain."""
        return np.maximum(squares[:, None] + self.squares[at] - 2.0 * (x @ self.x[at].T), 0.0)

    def _exactly(self, row: np.ndarray, at: np.ndarray) -> tuple[int, int]:
        """The nearest of some centroids for one vector with large components, in whole numbers."""
        own = [int(c) for c in row]
        return min((sum((a - b) ** 2 for a, b in zip(own, self.whole[k], strict=True)), int(k)) for k in self.number[at])

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector the positions [low, high) of its candidates, and whether its search needs whole numbers throughout."""
        squares = (x * x).sum(1)
        norms = np.sqrt(squares)
        after = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        before = np.maximum(after - 1, 0)
        bound = np.sqrt(np.minimum(((x - self.x[before]) ** 2).sum(1), ((x - self.x[after]) ** 2).sum(1)))
        slack = 1e-9 * (norms + bound) + 1e-6
        low = np.searchsorted(self.norms, norms - bound - slack, "left")
        high = np.searchsorted(self.norms, norms + bound + slack, "right")
        return np.minimum(low, before), np.maximum(high, after + 1), np.abs(x).max(1) > PLAIN

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """Centroid numbers, exact squared distances, and how many vectors and centroids were compared."""
        n = len(x)
        cluster, distance, compared = np.zeros(n, np.int32), [0] * n, 0
        if not n:
            return cluster, distance, 0
        low, high, large = self.annulus(x)
        compared = int((high - low).sum())
        held = np.concatenate([[0], np.cumsum(self.large)])
        large |= held[high] > held[low]  # a large candidate as well
        for i in np.flatnonzero(large):
            distance[i], cluster[i] = self._exactly(x[i], np.arange(low[i], high[i]))
        plain = np.flatnonzero(~large)
        plain = plain[np.argsort(low[plain] + high[plain], kind="stable")]  # neighbours have much the same annulus
        squares = (x * x).sum(1)
        for a in range(0, len(plain), BLOCK):
            rows = plain[a : a + BLOCK]
            at = np.arange(low[rows].min(), high[rows].max())
            at = at[~self.large[at]]
            d = self._distances(x[rows], at, squares[rows])
            d[(at < low[rows, None]) | (at >= high[rows, None])] = np.inf
            best = d.min(1)
            cluster[rows] = np.where(d == best[:, None], self.number[at], len(self.whole)).min(1)
            for i, value in zip(rows.tolist(), best.tolist(), strict=True):
                distance[i] = int(value)
        return cluster, distance, compared


def starts(rows: DataFrame, k: int, seed: int) -> Centroids | None:
    """The first centroids; the driver gets k vectors."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    found = hashed.orderBy("h", "v").limit(k).select("v").collect()
    if not found:
        return None
    x = integers(pa.array([r.v for r in found], pa.list_(pa.float64())), len(found[0].v))
    return Centroids([[int(c) for c in row] for row in x])


def _sums(rows: DataFrame, centroids: Centroids, size: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster met: how many vectors, and the sums of their components."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    exact = pa.decimal128(38, 0)
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value.whole)
        counts, sums = [0] * k, [[0] * size for _ in range(k)]
        for batch in batches:
            x = integers(batch.column(0), size)
            cluster, _, _ = shared.value.nearest(x)
            plain = bool(len(x)) and float(np.abs(x).max()) <= PLAIN
            for c in np.unique(cluster):
                own = x[cluster == c]
                counts[c] += len(own)
                # sums of one batch's plain components are exact in doubles
                more = own.sum(0).tolist() if plain else [sum(map(int, col)) for col in own.T]
                sums[c] = [a + int(b) for a, b in zip(sums[c], more, strict=True)]
        met = [c for c in range(k) if counts[c]]
        if met:
            columns = [pa.array(met, pa.int32()), pa.array([counts[c] for c in met], pa.int64())]
            columns += [pa.array([Decimal(sums[c][i]) for c in met], exact) for i in range(size)]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in names)
    out = rows.select("v").mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    shared.unpersist()
    return {r.cluster: (r.n, [int(r[c]) for c in names]) for r in out}


def fit(rows: DataFrame, k: int, size: int, rounds: int, seed: int) -> Centroids | None:
    """Centroids after so many rounds; None without vectors."""
    now = starts(rows, k, seed)
    for _ in range(rounds if now else 0):
        found = _sums(rows, now, size)
        now = Centroids([[s // found[c][0] for s in found[c][1]] if c in found else own for c, own in enumerate(now.whole)])
    return now


def assign(rows: DataFrame, centroids: Centroids, size: int) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = shared.value.nearest(integers(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array([min(d, LARGEST) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, ASSIGNED)


def cluster(vectors: DataFrame, *, k: int = 40, size: int = 64, rounds: int = 5, seed: int = 2, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    rows, spark = kept(vectors, size, column), vectors.sparkSession
    told = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = fit(rows, k, size, rounds, seed)
    if centroids is None:
        return spark.createDataFrame([], f"{ASSIGNED}, {told.split(', ', 1)[1]}")
    assigned = assign(rows, centroids, size)
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    total = min(sum(sums.values()), LARGEST)
    table = spark.createDataFrame([(c, min(d, LARGEST), total, centroids.digest(c)) for c, d in sorted(sums.items())], told)
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
