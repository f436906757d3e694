"""Clustering of vectors around centroids, with Orchard's search for the nearest one.

Vectors are whole numbers, so every distance and mean is exact and no result
depends on the order of additions. The centroids, a small fixed number of them, are
broadcast with a list for each: the others by ascending distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.common import stored

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Components are below this in magnitude, so that the squared distance of two vectors fits in 63 bits.
LARGEST = 1 << 27


class Orchard:
    """Nearest centroid by walking the neighbour list of the best one so far.

    A walk ends where the next neighbour is strictly more than twice as far from the
    best centroid as the query is: nothing behind it can be as near. Equal distances go
    to the smaller number. A closer centroid makes the walk go on in its own list;
    centroids that were seen are not measured again.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        apart = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
        order = np.argsort(apart, axis=1, kind="stable")
        own = np.arange(len(centroids))[:, None]
        self.lists = order[order != own].reshape(len(centroids), -1)
        self.apart = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector; all walks go on side by side."""
        n, k = len(vectors), len(self.centroids)
        best = np.zeros(n, np.int64)
        distance = ((vectors - self.centroids[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)
        walks = np.arange(n) if k > 1 else np.arange(0)
        while len(walks):
            place, here = at[walks], best[walks]
            # Squared: more than twice as far is more than four times the square.
            walks = walks[self.apart[here, place] <= 4 * distance[walks]]
            other = self.lists[best[walks], at[walks]]
            at[walks] += 1
            new = ~seen[walks, other]
            rows, other = walks[new], other[new]
            seen[rows, other] = True
            d = ((vectors[rows] - self.centroids[other]) ** 2).sum(axis=1)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (other < best[rows]))
            rows = rows[closer]
            best[rows], distance[rows], at[rows] = other[closer], d[closer], 0
            walks = walks[at[walks] < k - 1]
        return best, distance


def _sound(v: Column, width: int, scale: int) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == width) & whole, F.lit(False))


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors of `width` components, none null or non-finite, as floor(scale * x).

    A component of LARGEST / scale or more in magnitude stops the query: distances would not fit.
    """
    v = F.col("v")
    doubles = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(_sound(v, width, scale))
    fits = F.forall(v, lambda x: F.abs(x * scale) < LARGEST)
    checked = F.when(fits, v).otherwise(F.raise_error(F.lit(f"a component is too large: {LARGEST // scale} or more")).cast("array<double>"))
    return doubles.select("id", F.transform(checked, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of `seed:id`, in that order; null ids last, equal ids by their vectors."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(named.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, i, total): component sums of each cluster's vectors, and their number under i = -1.

    A task returns one row a component and cluster that it met; the sums are as many, whatever the table.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(Orchard(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = shared.value, len(centroids)
        # Python integers, so that no number of rows overflows.
        total = np.zeros((k, centroids.shape[1] + 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(0))
            best, _ = search.nearest(v)
            for c in np.unique(best).tolist():
                own = v[best == c]
                total[c] += np.r_[len(own), own.sum(axis=0)].astype(object)
        c, i = np.nonzero((total[:, :1] != 0) & np.ones(total.shape, bool))
        out = [pa.array(c, pa.int32()), pa.array(i - 1, pa.int32()), pa.array([str(x) for x in total[c, i]], pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["cluster", "i", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, i int, total string")
    return parts.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def moved(centroids: np.ndarray, totals: list) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; those without vectors stay."""
    after = centroids.copy()
    found = {(r.cluster, r.i): int(r.total) for r in totals}
    for (c, i), total in found.items():
        if i >= 0:
            after[c, i] = total // found[c, -1]
    return after


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    width: int = WIDTH,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every sound vector, and the final centroids.

    Vectors that are null, of another length, or hold null or non-finite
    components are left out. Rows may repeat ids and vectors; each counts. With fewer vectors
    than clusters there are as many clusters as vectors; without any the
    result is empty. Other columns are not read.
    """
    vectors = stored(whole_numbers(rows, id_col, vector_col, width, scale), "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    id_type = rows.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, cluster int, distance bigint"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col), centroids
    for _ in range(rounds):
        centroids = moved(centroids, sums(vectors, centroids))
    shared = rows.sparkSession.sparkContext.broadcast(Orchard(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance = shared.value.nearest(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return stored(vectors.mapInArrow(run, schema), "assigned").withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add `cluster_inertia`, `inertia` (exact sums of the distances) and `centroid_sha256`."""
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    every = int(sum(r.s for r in own))
    # One row a centroid.
    table = [(r.cluster, int(r.s), every, digest(centroids[r.cluster])) for r in own]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(table, schema)), "cluster")
