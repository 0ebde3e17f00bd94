"""Clusters of integer vectors around centroids by sort-means.

Each round sorts, for each centroid, the others by their distance from it. A vector starts from the centroid it had before and
scans the others in that order, stopping at the first that is strictly beyond twice the vector's distance from where it
started: by the triangle inequality neither it nor any after it is nearer, and one at exactly twice may be as near.
All numbers are integers, so squared distances, sums and means are exact. Only centroids, k x dim numbers, meet the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import drop_table, materialize

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Greatest magnitude of an integer component: squared distances of vectors of 64 such components fit a long.
LARGEST = (1 << 27) - 1
_ROWS = 16384


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the rows whose embedding has dim components, all of them finite and
    within LARGEST after that."""
    e = F.col("embedding").cast("array<double>")
    scaled = lambda x: F.floor(F.lit(float(scale)) * x)
    most = F.lit(float(LARGEST))
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(F.lit(float(scale)) * x) <= most), F.lit(False)))
    kept = vectors.where(F.coalesce(F.size(e) == dim, F.lit(False))).where(F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: scaled(x).cast("int")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every row of x; before: the cluster each had, from which its scan starts."""
    found, distance = before.copy(), np.empty(len(x), np.int64)
    for a in np.unique(before):
        here = np.flatnonzero(before == a)
        start = _squares(x[here] - centroids[a])
        apart = _squares(centroids - centroids[a])
        order = np.lexsort((np.arange(len(centroids)), apart))
        order = order[order != a]
        best, cluster = start.copy(), np.full(len(here), a)
        # Numbers of centroids within twice the distance, that is four times its square: apart / 4 rounded up avoids an overflow.
        reach = np.searchsorted(-(-apart[order] // 4), start, side="right")
        for j, c in enumerate(order):
            rows = np.flatnonzero(reach > j)
            if not len(rows):
                break
            d = _squares(x[here[rows]] - centroids[c])
            nearer = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            rows, d = rows[nearer], d[nearer]
            best[rows], cluster[rows] = d, c
        found[here], distance[here] = cluster, best
    return found, distance


def _assigned(rows: DataFrame, centroids: np.ndarray, started: bool) -> DataFrame:
    """vec_id, v, cluster, distance; started: rows have the cluster of the round before."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                before = part.column("cluster").to_numpy().astype(np.int64) if started else np.zeros(part.num_rows, np.int64)
                cluster, distance = nearest(_matrix(part.column("v")), centroids, before)
                cols = [part.column("vec_id"), part.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id bigint, v array<int>, cluster int, distance bigint")


def _sums(assigned: DataFrame, k: int, dim: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Number of vectors and sum of each component by cluster: every task sums its own rows, at most k results each."""

    def run(batches):
        n, total = np.zeros(k, np.int64), [[0] * dim for _ in range(k)]
        for batch in batches:
            x, cluster = _matrix(batch.column("v")), batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                here = cluster == c
                n[c] += here.sum()
                total[c] = [s + int(t) for s, t in zip(total[c], x[here].sum(axis=0), strict=True)]
        used = np.flatnonzero(n)
        if len(used):
            names = ["cluster", "n", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array([total[c] for c in used], pa.list_(pa.int64()))], names=names)

    parts = assigned.select("v", "cluster").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    # The count goes first as one more component; totals are decimals, since those of very many vectors are beyond a long.
    each = parts.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("sums"))).alias("i", "s"))
    rows = each.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()  # k * (dim + 1) rows at most
    sums: dict[int, list[int]] = {c: [0] * (dim + 1) for c in {r["cluster"] for r in rows}}
    for r in rows:
        sums[r["cluster"]][r["i"]] = int(r["s"])
    return {c: s[0] for c, s in sums.items()}, {c: s[1:] for c, s in sums.items()}


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, with_vectors: bool = False) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (and v) of every vector that is kept.

    Kept are vectors of dim components, none null or non-finite; each becomes integers floor(scale * x). Those with a component
    beyond LARGEST in magnitude then are left out too, as their squared distances have no long. Centroids start as the kept
    vectors whose sha256 of `1:<vec_id>` is smallest, ties by vector, rows without vec_id last; if fewer are kept, there
    are as many as that. Rows that repeat a vec_id or a vector are vectors of their own, with or without vec_id.
    The label and other columns don't matter. An empty table gives no rows. Inertias beyond a long are null.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dim, scale), "vectors")
    key = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    first = rows.select("v", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        ddl = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], ddl + ", v array<int>" * with_vectors)
    started = False
    for _ in range(rounds):
        done = materialize(_assigned(rows, centroids, started), "assigned")
        drop_table(rows)
        n, sums = _sums(done, len(centroids), dim)
        for c in n:
            centroids[c] = [s // n[c] for s in sums[c]]
        rows, started = done, True
    done = materialize(_assigned(rows, centroids, started), "assigned")
    drop_table(rows)
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda s: s if s < 1 << 63 else None
    each = spark.createDataFrame([(c, fits(s), fits(sum(inertia.values())), shas[c]) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = done.join(F.broadcast(each), "cluster")  # k rows at most
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", *["v"] * with_vectors)
