"""Integer k-means whose nearest-centroid search is progressive over Walsh-Hadamard coefficients.

The transform of integers is exact and keeps distances up to the factor of the dimension. Differences
of coefficients are added up from coarse to fine; a centroid whose sum so far is above a distance that
another one is known to have cannot win and is left out of the finer bands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_frame
from .common import c, finite, fold_partitions, map_batches, matrix

WIDTH, SCALE = 64, 1024
EXACT = 1 << 24  # below it, sums over 64 squared differences of coefficients stay within 63 bits
BLOCK = 4_096  # vectors compared at a time


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows (their length a power of two), lowest sequency first."""
    n, d = x.shape
    y, h = x, 1
    while h < d:
        pairs = y.reshape(n, d // (2 * h), 2, h)
        y = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return y[:, sequency_order(d)]


def sequency_order(d: int) -> np.ndarray:
    """Numbers of the Walsh functions by how often they change sign."""
    rows = np.arange(d)
    signs = np.array([[(int(a) & int(b)).bit_count() & 1 for b in rows] for a in rows])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): as int64 where all later sums fit, else as Python integers."""
    whole = np.floor(scale * x.astype(np.float64))
    if not whole.size or np.abs(whole).max() < EXACT:
        return whole.astype(np.int64)
    return np.array([[int(v) for v in row] for row in whole], dtype=object)


def nearest_centroids(coefs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest row of *centroids* for each row of *coefs* (both transformed), the squared distance of the
    coefficients, and how many coefficient differences were formed. Ties go to the smaller number."""
    n, d = coefs.shape
    rows = np.arange(n)
    if coefs.dtype != centroids.dtype:
        coefs, centroids = coefs.astype(object), centroids.astype(object)
    sums = np.zeros((n, len(centroids)), coefs.dtype)
    alive = np.ones(sums.shape, bool)
    limit = None
    formed, start, stop = 0, 0, 1
    while start < d:
        r, k = np.nonzero(alive)
        diff = coefs[r, start:stop] - centroids[k, start:stop]
        sums[r, k] += (diff * diff).sum(1)
        formed += diff.size
        if stop < d and len(centroids) > 1:
            # the leader of each row is carried to the end: a distance that others must not exceed
            best = _least(sums, alive)
            rest = coefs[:, stop:] - centroids[best, stop:]
            reached = sums[rows, best] + (rest * rest).sum(1)
            formed += rest.size
            limit = reached if limit is None else np.minimum(limit, reached)
            alive &= sums <= limit[:, None]
        start, stop = stop, 2 * stop
    best = _least(sums, alive)
    return best, sums[rows, best], formed


def _least(sums: np.ndarray, alive: np.ndarray) -> np.ndarray:
    top = sums.max() if sums.size else 0
    return np.where(alive, sums, top + 1).argmin(1)


def usable(vectors: DataFrame, embedding: str = "embedding") -> Column:
    return F.coalesce(finite(c(embedding)) & (F.size(c(embedding)) == WIDTH), F.lit(False))


def _assigned(batch: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors as whole numbers, their clusters and squared distances, block by block."""
    moved = transform(centroids)
    for at in range(0, len(batch), BLOCK):
        x = whole_numbers(batch[at:at + BLOCK])
        cluster, total, _ = nearest_centroids(transform(x), moved)
        yield x, cluster, total // WIDTH


def _as_rows(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < EXACT for row in centroids for v in row)
    return np.array(centroids, dtype=np.int64 if small else object).reshape(-1, WIDTH)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean, empty clusters stay."""
    k = len(centroids)

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        count, sums = np.zeros(k, np.int64), np.zeros((k, WIDTH), object)
        for batch in batches:
            for x, cluster, _ in _assigned(matrix(batch.column(0)), centroids):
                for j in np.unique(cluster):
                    own = x[cluster == j]
                    count[j] += len(own)
                    sums[j] += own.sum(0)
        used = np.flatnonzero(count)
        return {"cluster": used, "n": count[used], "sums": [[int(v) for v in sums[j]] for j in used]} if len(used) else None

    parts = fold_partitions(rows.select("embedding"), fold, "cluster int, n bigint, sums array<bigint>")
    # one row per cluster, whatever the number of vectors
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(WIDTH)])
    out = [[int(v) for v in row] for row in centroids]
    for row in totals.collect():
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(WIDTH)]
    return _as_rows(out)


def fit_centroids(rows: DataFrame, clusters: int = 8, rounds: int = 10, salt: str = "3") -> np.ndarray:
    """Centroids after *rounds* rounds over usable (vec_id, embedding) rows, fewer than *clusters* if the rows are fewer.

    They start as the vectors whose ids hash lowest; rows without an id come last, and equal ids are ordered by vector.
    """
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), F.col("embedding")).limit(clusters).collect()
    centroids = _as_rows([[int(v) for v in whole_numbers(np.array([r.embedding]))[0]] for r in first])
    for _ in range(rounds if first else 0):
        centroids = _moved(rows, centroids)
    return centroids


def cluster_vectors(
    vectors: DataFrame, *, clusters: int = 8, rounds: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of 64 finite components.

    Components count as floor(1024 * x). Rows with a NULL vector, another length, or NULL or non-finite
    components are left out; rows without an id or with a repeated one are vectors like any other. No
    usable row gives no row. Ties go to the smaller cluster number. Distances beyond 63 bits raise an error.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vectors, embedding)).select(
        c(vec_id).alias("vec_id"), c(embedding).cast("array<double>").alias("embedding"))
    centroids = fit_centroids(rows, clusters, rounds)

    def run(batch: pa.RecordBatch) -> dict:
        parts = list(_assigned(matrix(batch.column(1)), centroids))
        return {"vec_id": batch.column(0), "cluster": np.concatenate([p[1] for p in parts]).astype(np.int32),
                "distance": [int(v) for p in parts for v in p[2]]}

    kind = rows.schema["vec_id"].dataType.simpleString()
    assigned = map_batches(rows, run, f"vec_id {kind}, cluster int, distance bigint", rows=BLOCK)
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids]
    known = local_frame(
        spark, [(j, s, sum(inertia.values()), digest[j]) for j, s in sorted(inertia.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(clusters: int, rounds: int) -> str:
    parts = [f"""
kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH}),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, x
    FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
    SELECT vec_id, x, d AS distance, cluster FROM (
        SELECT vec_id, x, cluster, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS place
        FROM (SELECT k.vec_id, k.x, c.cluster,
                     list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
              FROM kept k CROSS JOIN c{i} c))
    WHERE place = 1)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.x, c.x) AS x
    FROM c{i} c LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x
        FROM (SELECT cluster, place, sum(v) AS s, count(*) AS n
              FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{i})
              GROUP BY cluster, place)
        GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return "WITH" + ",".join(parts) + f"""
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


OP13_SQL = _rounds_sql(8, 10)
