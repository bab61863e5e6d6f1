"""Clustering integer vectors around centroids, with an equal-average equal-variance search for the nearest one.

The distance of two vectors is at least what their means and their deviations from their means
differ by: ``d * (mean x - mean c)² + (deviation x - deviation c)² <= |x - c|²``. Centroids are kept
sorted by mean. A vector's search starts at its own mean and goes outward to the nearer side; it ends
when the means alone lie further apart than the best distance found, and skips a centroid whose mean
and deviation rule it out. Centroids that pass are measured in whole numbers, so the result is exact.

A round of clustering is one pass: every task sums its vectors by centroid, and Spark adds the sums.
Only ``k`` rows of sums reach the driver in a round, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

#: Components are below this, so that a squared distance of up to 128 components is a 64-bit number.
MOST = 1 << 27
#: Relative room for rounding in the two bounds. They only rule centroids out; distances are whole numbers.
ROOM = 1e-11


@dataclass
class Search:
    """Centroids (rows of whole numbers) sorted by the mean of their components."""

    numbers: np.ndarray
    rows: np.ndarray
    sums: np.ndarray
    deviations: np.ndarray

    @classmethod
    def over(cls, centroids: np.ndarray) -> Search:
        sums = centroids.sum(1)
        order = np.argsort(sums, kind="stable")
        return cls(order, centroids[order], sums[order], deviations(centroids[order]))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each vector the nearest centroid (the smaller number of equals), its squared distance, and how many distances were measured."""
        n, d = vectors.shape
        k = len(self.numbers)
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        sums, spread = vectors.sum(1), deviations(vectors)
        room = ROOM * (1.0 + max(np.abs(vectors).max(initial=0), np.abs(self.rows).max(initial=0)))
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        going, measured = np.arange(n), 0
        while len(going):
            a, b, own = left[going], right[going], sums[going]
            below = np.where(a >= 0, own - self.sums[np.maximum(a, 0)], np.inf)
            above = np.where(b < k, self.sums[np.minimum(b, k - 1)] - own, np.inf)
            step = np.minimum(below, above)
            apart = d * np.maximum(step / d - room, 0) ** 2
            open_ = apart <= best[going] * (1 + ROOM)  # an endless step is never open
            going, at, lower, apart = going[open_], np.where(below <= above, a, b)[open_], (below <= above)[open_], apart[open_]
            left[going[lower]] -= 1
            right[going[~lower]] += 1
            apart += np.maximum(np.abs(spread[going] - self.deviations[at]) - room, 0) ** 2
            passed = apart <= best[going] * (1 + ROOM)
            who, at = going[passed], at[passed]
            distance = ((vectors[who] - self.rows[at]) ** 2).sum(1)
            measured += len(who)
            number = self.numbers[at]
            nearer = (distance < best[who]) | ((distance == best[who]) & (number < found[who]))
            best[who[nearer]], found[who[nearer]] = distance[nearer], number[nearer]
        return found, best, measured


def deviations(vectors: np.ndarray) -> np.ndarray:
    """The length of each vector less its mean."""
    return np.sqrt(((vectors - vectors.mean(1, keepdims=True)) ** 2).sum(1))


def whole_vectors(batch: pa.RecordBatch, column: int, dimensions: int, scale: int) -> np.ndarray:
    return whole(batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    values = np.floor(values * scale)
    if np.abs(values).max(initial=0) >= MOST:
        raise OverflowError(f"a vector has a component of {MOST} or more after scaling: its squared distances exceed 64-bit numbers")
    return values.astype(np.int64)


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has all its components, each of them a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & ~F.coalesce(bad, F.lit(True))


@dataclass
class Clustering:
    """``assigned`` has (id, cluster, distance), ``centroids`` one row of whole numbers per cluster."""

    assigned: DataFrame
    centroids: np.ndarray

    def table(self) -> DataFrame:
        """(cluster, centroid): one row per cluster, ``k`` at most."""
        rows = [(i, c) for i, c in enumerate(self.centroids.tolist())]
        return self.assigned.sparkSession.createDataFrame(rows, "cluster int, centroid array<bigint>")


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, seed: int | str = 2, scale: int = 256, dimensions: int = 64, id_column: str = "vec_id", vector_column: str = "embedding"
) -> Clustering:
    """Clusters the vectors of ``df``, each component taken as ``floor(scale * x)``.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:id``. Each round
    assigns every vector to its nearest centroid and then moves each centroid that has vectors to
    the floor of their mean; one that has none stays. Then vectors are assigned once more.

    Vectors that are null, of another length, or hold a null or non-finite component are left out.
    Ties go to the smaller number. Repeated rows count as often as they stand, and rows of one id
    are ordered by their components; a null id counts as an empty text in the hash and stays null.
    With fewer than ``k`` vectors every one is a centroid at first; an empty table gives no rows.
    Other columns are ignored, whatever their names. A component of 2^27 or more after scaling ends
    the job with an OverflowError, since its distances do not fit the result.
    """
    key = df.schema[id_column].dataType.simpleString()
    vector = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).alias("id"), vector.alias("v")).where(usable(F.col("v"), dimensions))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()  # k rows
    centroids = whole(np.array([r.v for r in first], float).reshape(-1, dimensions), scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids, dimensions, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search.over(centroids)
        for batch in batches:
            found, best, _ = search.nearest(whole_vectors(batch, 1, dimensions, scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array(best, pa.int64())], names=["id", "cluster", "distance"])

    return Clustering(rows.mapInArrow(assign, f"id {key}, cluster int, distance bigint").withColumnRenamed("id", id_column), centroids)


def _moved(rows: DataFrame, centroids: np.ndarray, dimensions: int, scale: int) -> np.ndarray:
    """The centroids after one round. A task returns one row of sums per centroid it met."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search.over(centroids)
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = whole_vectors(batch, 0, dimensions, scale)
            found = search.nearest(vectors)[0]
            np.add.at(total, found, vectors)
            count += np.bincount(found, minlength=len(centroids))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met], pa.int64()), pa.array(total[met].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"]
        )

    parts = rows.select("v").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows
        moved[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(dimensions)]
    return moved


def with_inertia(clustering: Clustering) -> DataFrame:
    """``assigned`` with the sums of distances over each vector's cluster and over all."""
    assigned = materialize(clustering.assigned)
    totals = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    every = sum(r.cluster_inertia for r in totals)
    table = assigned.sparkSession.createDataFrame([(r.cluster, r.cluster_inertia, every) for r in totals], "cluster int, cluster_inertia bigint, inertia bigint")
    return assigned.join(F.broadcast(table), "cluster")
