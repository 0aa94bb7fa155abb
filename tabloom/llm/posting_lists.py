"""Nearest neighbours by balanced posting lists.

Centroids of balanced clusters are held in memory and searched by a graph. A vector near
the boundary of clusters is filed in several lists. A query reads the lists whose
centroids are not much farther than the nearest one, and distances there are exact. How much
farther is measured: a few queries are compared with all rows, and the ratio is the least one
under which the wanted share of their neighbours is in a list that is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, c, fold_partitions, map_batches, matrix, stored

# Bounds of the fit; every row is indexed.
SAMPLE_ROWS, SAMPLE_QUERIES = 16_384, 128
WANTED_RECALL = 0.95
LISTS_PER_ROOT = 0.5  # lists for each unit of the square root of the rows: both grow, lists and their lengths
DEGREE, BEAM, EXPAND = 16, 64, 8  # the beam of a first search; it grows until the ratio ends the lists
REPLICAS, REPLICA_RATIO = 3, 1.05
LEAST_PROBES = 8  # read first; what they hold bounds what the other lists have to return
BLOCK_ROWS = 4_096


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of clusters of equal size: each is cut at the median along its direction of largest spread."""
    rng = np.random.default_rng(7)
    heap, done = [(np.arange(len(sample)), lists)], []
    while heap:
        rows, parts = heap.pop()
        if parts <= 1 or len(rows) < 2:
            done.append(sample[rows].mean(0))
            continue
        x = sample[rows] - sample[rows].mean(0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(6):  # power iteration
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) or 1.0
        order = np.argsort(x @ v, kind="stable")
        half = parts // 2
        cut = len(rows) * half // parts
        heap += [(rows[order[:cut]], half), (rows[order[cut:]], parts - half)]
    return np.array(done)


@dataclass
class CentroidGraph:
    """Each centroid is linked to its nearest ones, both ways; searches walk towards the query."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> "CentroidGraph":
        k = len(centroids)
        degree = min(DEGREE, k - 1)
        norms = (centroids**2).sum(1)
        out: list[set[int]] = [set() for _ in range(k)]
        for a in range(0, k, 256):
            d = norms[None, :] - 2 * centroids[a:a + 256] @ centroids.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            for i, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :degree]):
                for j in near:
                    out[a + i].add(int(j))
                    out[int(j)].add(a + i)
        width = max([1, *map(len, out)])
        links = np.full((k, width), -1)
        for i, near in enumerate(out):
            links[i, :len(near)] = sorted(near)
        # starting points far apart from each other, so no part of the graph is out of reach
        entries, d = [0], ((centroids - centroids[0])**2).sum(1)
        while len(entries) < min(16, k):
            entries.append(int(d.argmax()))
            d = np.minimum(d, ((centroids - centroids[entries[-1]])**2).sum(1))
        return cls(centroids, links, np.unique(entries))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found for each row of *x* and their distances, nearest first (-1, inf where none)."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k + 1), bool)  # the last column stands for "no link"
        ids = np.tile(self.entries, (n, 1))
        seen[rows, ids] = True
        dist = self._distances(x, ids)
        open_ = np.ones(ids.shape, bool)
        while True:
            order = np.lexsort((ids, dist))[:, :beam]
            ids, dist, open_ = ids[rows, order], dist[rows, order], open_[rows, order]
            rank = np.where(open_, np.cumsum(open_, axis=1), EXPAND + 1)
            now = (rank <= EXPAND) & (ids >= 0)
            if not now.any():
                return ids, np.sqrt(dist)
            open_ &= ~now
            near = np.where(now[:, :, None], self.links[ids], -1).reshape(n, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            seen[rows, near] = True
            seen[:, k] = False
            keep = max(1, int((near >= 0).sum(1).max()))
            near = -np.sort(-near, axis=1)[:, :keep]
            ids = np.concatenate((ids, near), axis=1)
            dist = np.concatenate((dist, self._distances(x, near)), axis=1)
            open_ = np.concatenate((open_, near >= 0), axis=1)

    def _distances(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        norms = (self.centroids**2).sum(1)
        dots = np.einsum("nkd,nd->nk", self.centroids[ids], x)
        return np.where(ids < 0, np.inf, np.maximum((x**2).sum(1)[:, None] - 2 * dots + norms[ids], 0))

    def files(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists in which each vector is filed: the nearest, and others almost as near on another side of it."""
        ids, dist = self.search(x, 32)
        out = []
        for found, d in zip(ids, dist):
            chosen: list[int] = []
            for j, dj in zip(found, d):
                if j < 0 or len(chosen) == REPLICAS or dj > REPLICA_RATIO * d[0] + 1e-12:
                    break
                # not if a list chosen before lies between it and the nearest one; distances between centroids,
                # as a vector can be farther from all of them than they are from each other
                away = np.linalg.norm(self.centroids[chosen] - self.centroids[j], axis=1)
                if not chosen or (away[1:] >= away[0]).all():
                    chosen.append(int(j))
            out.append(np.array(chosen))
        return out

    def probes(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """Lists a query reads, nearest first: those within *ratio* of the nearest, LEAST_PROBES at least."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(x)
        rows, beam = np.arange(len(x)), BEAM
        while len(rows):
            if 4 * beam < len(self.centroids):
                ids, dist = self.search(x[rows], beam)
            else:  # a beam this wide looks at nearly all centroids anyway
                ids = np.tile(np.arange(len(self.centroids)), (len(rows), 1))
                dist = np.sqrt(self._distances(x[rows], ids))
                order = np.lexsort((ids, dist))
                ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            use = (ids >= 0) & ((dist <= ratio * dist[:, :1]) | (np.arange(ids.shape[1]) < LEAST_PROBES))
            # the ratio decides, not the beam: where the last list found is within it, more are sought
            more = use[:, -1] & (ids.shape[1] < len(self.centroids))
            for row, f, u in zip(rows[~more], ids[~more], use[~more]):
                out[row] = f[u]
            rows, beam = rows[more], 4 * beam
        return out


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of rows with an id and a finite vector that is not zero.

    Vectors of another length than the most frequent one (the longer of two as frequent) take no part.
    """
    rows = vectors.select(c(vec_id).cast("bigint").alias("vec_id"), c(embedding).cast("array<double>").alias("embedding"))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists("embedding", lambda e: e != 0))
    width = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("embedding") == (width.d if width else 0))


def build_graph(rows: DataFrame, total: int) -> CentroidGraph:
    sample = bounded_sample(rows, "vec_id", SAMPLE_ROWS).select("embedding").toArrow().combine_chunks()
    x = matrix(pa.concat_arrays(sample.column(0).chunks))
    lists = max(1, min(math.ceil(LISTS_PER_ROOT * math.sqrt(total)), len(x) // 4))
    return CentroidGraph.build(balanced_centroids(x, lists))


def probe_ratio(
    rows: DataFrame, queries: DataFrame, graph: CentroidGraph, count: int, recall: float = WANTED_RECALL,
    sample: int = SAMPLE_QUERIES,
) -> float:
    """The least ratio under which *recall* of the *count* nearest vectors are in a list that is read.

    Measured on at most *sample* queries, whose nearest vectors come from all rows; each
    partition returns *count* of them for a query.
    """
    asked = bounded_sample(queries, "vec_id", sample).toArrow().combine_chunks()
    if not len(asked):
        return 1.0
    ids = asked.column("vec_id").to_numpy()
    q = matrix(pa.concat_arrays(asked.column("embedding").chunks))
    to_lists = np.array([np.linalg.norm(graph.centroids - v, axis=1) for v in q])
    to_lists /= np.maximum(to_lists.min(1, keepdims=True), 1e-300)

    def nearest(batches: Iterator[pa.RecordBatch]) -> dict[str, list] | None:
        best = [(np.empty(0), np.empty(0, np.int64), np.empty((0, q.shape[1]))) for _ in ids]
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
            for i, query in enumerate(ids):
                d = np.linalg.norm(x - q[i], axis=1)
                d[own == query] = np.inf
                near = np.argpartition(d, count - 1)[:count] if len(d) > count else np.arange(len(d))
                d, n, v = (np.concatenate(pair) for pair in zip(best[i], (d[near], own[near], x[near])))
                order = np.lexsort((n, d))[:count]
                best[i] = d[order], n[order], v[order]
        kept = [np.isfinite(d) for d, _, _ in best]
        lists = graph.files(np.concatenate([v[k] for k, (_, _, v) in zip(kept, best)]))
        of = np.repeat(np.arange(len(ids)), [k.sum() for k in kept])
        return {
            "query": of, "vec_id": np.concatenate([n[k] for k, (_, n, _) in zip(kept, best)]),
            "score": np.concatenate([d[k] for k, (d, _, _) in zip(kept, best)]),
            "needs": [float(to_lists[i, found].min()) for i, found in zip(of, lists)]}

    found = fold_partitions(
        rows.select("vec_id", "embedding"), _if_any(nearest), "query int, vec_id bigint, score double, needs double")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    needs = (
        found.dropDuplicates(["query", "vec_id"]).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= count).select("needs").toArrow().column(0).to_numpy())
    return float(max(1.0, np.quantile(needs, recall, method="higher"))) if len(needs) else 1.0


def _if_any(fold):
    """*fold* for partitions with rows, None for the others."""
    def run(batches: Iterator[pa.RecordBatch]):
        first = next(batches, None)
        return None if first is None else fold(chain([first], batches))

    return run


def _filed(rows: DataFrame, graph: CentroidGraph) -> DataFrame:
    """Every vector in each of its lists."""
    def run(batch: pa.RecordBatch) -> dict:
        lists = graph.files(matrix(batch.column(1)))
        take = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in lists]))
        return {"list": np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64),
                "vec_id": batch.column(0).take(take), "embedding": batch.column(1).take(take)}

    return map_batches(
        rows.select("vec_id", "embedding"), run, "list bigint, vec_id bigint, embedding array<double>", rows=256)


def _probed(queries: DataFrame, graph: CentroidGraph, ratio: float) -> DataFrame:
    """Every query with each list it reads; place 0 is the nearest list."""
    def run(batch: pa.RecordBatch) -> dict:
        lists = graph.probes(matrix(batch.column(1)), ratio)
        take = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in lists]))
        return {"list": np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64),
                "place": np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in lists]]),
                "vec_id": batch.column(0).take(take), "embedding": batch.column(1).take(take)}

    return map_batches(
        queries.select("vec_id", "embedding"), run,
        "list bigint, place int, vec_id bigint, embedding array<double>", rows=256)


def _top(left: pa.Table, right: pa.Table, count: int) -> pa.Table:
    """The *count* nearest rows of *right* within the bound of each query of *left*; exact, ties to smaller ids."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        q, x = (matrix(pa.concat_arrays(t.column("embedding").chunks)) for t in (left, right))
        ids = right.column("vec_id").to_numpy()
        for query, bound, vector in zip(left.column("vec_id").to_pylist(), left.column("bound").to_pylist(), q):
            d = x - vector
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
            d[ids == query] = np.inf
            if len(d) > count:
                bound = min(bound, np.partition(d, count - 1)[count - 1])
            near = np.flatnonzero(d <= bound)
            near = near[np.lexsort((ids[near], d[near]))][:count]
            near = near[np.isfinite(d[near])]
            out["query_id"] += [query] * len(near)
            out["vec_id"] += ids[near].tolist()
            out["score"] += d[near].tolist()
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                     "score": pa.array(out["score"], pa.float64())})


def _blocks(spark: SparkSession, filed: DataFrame, asked: DataFrame) -> DataFrame:
    """list, blocks of its vectors, blocks of its queries: one row per list, a quarter of SAMPLE_ROWS at most."""
    counts = (
        filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        .join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
        .select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("vb"),
                F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("qb")))
    return F.broadcast(spark.createDataFrame(counts.toArrow(), schema=counts.schema))


def _numbers(name: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(name).cast("bigint") - 1)


def _search(spark: SparkSession, filed: DataFrame, asked: DataFrame, count: int) -> DataFrame:
    """query_id, vec_id, score: every query against every block of each list, what lies within its bound."""
    plan = _blocks(spark, filed, asked)
    rows = filed.join(plan, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "vb").alias("v"),
        F.explode(_numbers("qb")).alias("q"), "vec_id", "embedding")
    queries = asked.join(plan, "list").select(
        "list", F.explode(_numbers("vb")).alias("v"),
        F.pmod(F.xxhash64("vec_id"), "qb").alias("q"), "vec_id", "embedding", "bound")
    keys = ["list", "v", "q"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _top(left, right, count)

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        best, "query_id bigint, vec_id bigint, score double")


def _ranked(found: DataFrame, count: int) -> DataFrame:
    """Best *count* of each query; a vector found in several lists counts once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
        .select("query_id", "rank", "vec_id", "score"))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame | None = None, *, count: int = 10, vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the *count* nearest vectors found for each query, by Euclidean distance.

    *queries* has the columns of *vectors* (all of them if None); a query's own id is no
    candidate. Rows without an id, NULL or zero vectors and vectors with NULL or non-finite
    components take no part. Ties go to the smaller id; rows that repeat an id with the
    same vector count once. A query whose lists hold fewer than *count* candidates is
    compared with all lists, so it gets all there are.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, vec_id, embedding)
    total = rows.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], empty)
    graph = build_graph(rows, total)
    asked = rows if queries is None else usable_vectors(queries, vec_id, embedding)
    ratio = probe_ratio(rows, asked, graph, count)
    filed = stored(_filed(rows, graph), "posting-lists")
    probed = stored(_probed(asked, graph, ratio), "posting-probes")
    no_bound = F.lit(float("inf"))
    first = stored(
        _search(spark, filed, probed.filter(F.col("place") < LEAST_PROBES).withColumn("bound", no_bound), count),
        "posting-first")
    # what the nearest lists hold bounds what the others can add, so they return next to nothing else
    bounds = _ranked(first, count).filter(F.col("rank") == count).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    others = (
        probed.filter(F.col("place") >= LEAST_PROBES).join(bounds, "vec_id", "left")
        .withColumn("bound", F.coalesce("bound", no_bound)))
    found = stored(_ranked(first.unionByName(_search(spark, filed, others, count)), count), "posting-found")
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = (
        asked.join(have, F.col("vec_id") == F.col("query_id"), "left")
        .filter(F.coalesce("n", F.lit(0)) < min(count, total - 1)).select("vec_id", "embedding"))
    if not short.limit(1).count():
        return found
    short = stored(short, "posting-short")
    every = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(graph.centroids) - 1)))).select(
        F.col("list").cast("bigint").alias("list"), "vec_id", "embedding", no_bound.alias("bound"))
    rest = _ranked(_search(spark, filed, every, count), count)
    return found.join(
        short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def neighbour_documents(vectors: DataFrame) -> DataFrame:
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
