"""Near copies of vectors by sorted projection passes.

Each pass orders the vectors by concatenated random hashes (signs of random projections) and compares every
vector with its next neighbours in that order. Links of all passes are united; the number of links is
completed inside the components they form.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _importable, c, finite, map_batches, matrix, stored
from .components import connected_components

WINDOW, BITS = 64, 62
BLOCK = 4_096  # rows that are compared together, besides the WINDOW rows before them
MISS = 0.001  # wanted share of pairs at the limit that no pass meets
CELL = 2_048  # members of a component compared at a time


def passes_for(rows: int, limit: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the limit is missed with probability MISS, if the others lie anywhere.

    A pair meets if it shares the bits that leave about a window of other rows: log2(rows / window) of them,
    each shared with one minus the angle over pi. So passes grow as a small power of the rows, without a cap.
    """
    agree = 1 - math.acos(limit) / math.pi
    bits = max(1.0, math.log2(max(2, rows) / window) + 1)
    return max(4, math.ceil(math.log(MISS) / math.log(1 - agree**bits)))


def signatures(x: np.ndarray, number: int) -> np.ndarray:
    """Signs of BITS random projections of pass *number*, the first in the highest place."""
    planes = np.random.default_rng([number, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return ((x @ planes) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small entries stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row over the links a-b."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        low = low[low]
        if (low == before).all():
            break
    return low


def window_links(x: np.ndarray, group: np.ndarray, limit: float, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the smallest row they are joined to over neighbours at most *window* apart, of one group, at the limit."""
    u, n = unit(x), len(x)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, n, 256):
        stop, far = min(n, at + 256), min(n, at + 256 + window)
        i, j = np.nonzero(u[at:stop] @ u[at:far].T >= limit)
        keep = (j > i) & (j - i <= window)
        i, j = i[keep] + at, j[keep] + at
        same = group[i] == group[j]
        found_a.append(i[same])
        found_b.append(j[same])
    low = _smallest_reachable(n, np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(low != np.arange(n))
    return moved, low[moved]


def _flagged(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """All rows: vec_id, e (vector as doubles) and two hashes of it, NULL for vectors that link with nothing."""
    e = c(embedding).cast("array<double>")
    usable = F.coalesce(finite(e) & F.exists(e, lambda v: v != 0), F.lit(False)) & c(vec_id).isNotNull()
    rows = vectors.select(
        c(vec_id).alias("vec_id"), F.when(usable, F.transform(e, lambda v: v + F.lit(0.0))).alias("e"))  # -0.0 becomes 0.0
    width = rows.filter("e is not null").groupBy(F.size("e").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    known = F.when(F.size("e") == (width.d if width else 0), F.col("e"))
    return rows.select("vec_id", known.alias("e")).select(
        "vec_id", "e", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("h"),
        F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(1), "e")).alias("g"))


def _ranked(classes: DataFrame, passes: int) -> DataFrame:
    """(place, pass, h, g): every vector once per pass at its place in the order of (pass, signature, hashes).

    Ids of range partitions are written as data, so a lost executor cannot change them; a place is the
    rank inside its range plus the rows of the ranges before.
    """
    def run(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column(2))
        return {"h": batch.column(0).take(pa.array(np.tile(np.arange(len(x)), passes))),
                "g": batch.column(1).take(pa.array(np.tile(np.arange(len(x)), passes))),
                "pass": np.repeat(np.arange(passes, dtype=np.int32), len(x)),
                "sig": np.concatenate([signatures(x, p) for p in range(passes)])}

    keys = ["pass", "sig", "h", "g"]
    signed = map_batches(classes.select("h", "g", "e"), run, "h bigint, g bigint, pass int, sig bigint")
    parts = stored(signed.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "projection-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return parts.withColumn("rank", rank).join(offsets, "part").select(
        (F.col("offset") + F.col("rank") - 1).alias("place"), "pass", "h", "g")


def _links(classes: DataFrame, passes: int, limit: float, window: int, block: int) -> DataFrame:
    """(a, b): nodes joined by some window of some pass, at most one row per vector and pass."""
    own = F.floor(F.col("place") / block).cast("bigint")
    shared = F.pmod(F.col("place"), F.lit(block)) >= block - window
    rows = (
        _ranked(classes, passes).join(classes.select("h", "g", "node", "e"), ["h", "g"])
        .withColumn("block", F.explode(F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))))
        .select("block", "place", "pass", "node", "e"))
    _importable(classes.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        e = rows.column("e").combine_chunks()
        a, b = window_links(matrix(e), rows.column("pass").to_numpy(), limit, window)
        node = rows.column("node")
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    kind = classes.schema["node"].dataType.simpleString()
    return rows.groupBy("block").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def _cosine(x: str, y: str) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))


def _counted(members: DataFrame, limit: float, cell: int) -> DataFrame:
    """(node, root, links): all links of every member (root, node, n, e) inside its component.

    Members within half the limit's angle of the component's first vector are all linked with each other, so
    they need no comparison, however many they are. Only the others are compared, with all members, in cells
    of a bounded number of rows; no pair leaves its cell.
    """
    half = math.cos(math.acos(limit) / 2) + 1e-9
    leaders = members.filter("node = root").select("root", F.col("e").alias("leader"))
    placed = stored(
        members.join(leaders, "root").withColumn("inside", _cosine("e", "leader") >= half).drop("leader"), "projection-members")
    sizes = placed.groupBy("root").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("ball"),
        F.sum((~F.col("inside")).cast("bigint")).alias("outside"))
    rows = placed.join(sizes, "root")
    base = rows.select("node", "root", F.when(F.col("inside"), F.col("ball") - 1).otherwise(F.col("n") - 1).alias("links"))
    # outer rows in slices of a component against slices of all its members; small components share cells
    outer, inner = (F.ceil(F.col(x) / cell).cast("bigint") for x in ("outside", "size"))
    slice_of = lambda parts: F.pmod(F.xxhash64("node"), parts)
    alone = (F.col("outside") > cell) | (F.col("size") > cell)
    open_rows = sizes.filter("outside > 0").agg(F.sum("size")).first()[0] or 0
    bucket = F.when(alone, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(1 + open_rows // cell)))
    open_ = rows.filter("outside > 0").withColumn("bucket", bucket).withColumn("outer", outer).withColumn("inner", inner)
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    kept = ["root", "node", "n", "e", "inside"]
    left = open_.filter("not inside").select(
        "bucket", slice_of(F.col("outer")).alias("i"), every(F.col("inner")).alias("j"), F.lit(True).alias("asks"), *kept)
    right = open_.select(
        "bucket", every(F.col("outer")).alias("i"), slice_of(F.col("inner")).alias("j"), F.lit(False).alias("asks"), *kept)
    kind = members.schema["node"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        roots = rows.column("root").combine_chunks()
        key = pa.RecordBatch.from_struct_array(roots)
        ids = np.unique(np.stack([k.to_numpy(zero_copy_only=False) for k in key.columns], 1), axis=0, return_inverse=True)[1].ravel()
        nodes = np.stack([k.to_numpy(zero_copy_only=False) for k in pa.RecordBatch.from_struct_array(
            rows.column("node").combine_chunks()).columns], 1)
        asks, inside = (rows.column(x).to_numpy() for x in ("asks", "inside"))
        n, u = rows.column("n").to_numpy(), unit(matrix(rows.column("e").combine_chunks()))
        links = np.zeros(len(n), np.int64)
        order = np.argsort(ids, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
            a, b = own[asks[own]], own[~asks[own]]
            if not len(a) or not len(b):
                continue
            near = u[a] @ u[b].T >= limit
            near &= (nodes[a][:, None, :] != nodes[b][None, :, :]).any(2)
            links[a] += near @ n[b]
            # what is inside learns its links with the outside here; outer rows have asked for theirs
            links[b] += np.where(inside[b], n[a] @ near, 0)
        hit = np.flatnonzero(links)
        return pa.table({"node": rows.column("node").take(pa.array(hit)), "links": pa.array(links[hit])})

    more = left.unionAll(right).groupBy("bucket", "i", "j").applyInArrow(run, f"node {kind}, links bigint")
    return base.unionByName(more.withColumn("root", F.lit(None).cast(kind))).groupBy("node").agg(
        F.max("root").alias("root"), F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, *, limit: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
    window: int = WINDOW, block: int = BLOCK, cell: int = CELL, passes: int | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of *vectors*; links are pairs at a cosine of *limit* or more.

    Every row counts as a vector, also one that repeats another's id or vector; equal vectors are one node of
    the search, so copies cost what one costs. Rows with a NULL, empty or zero vector, NULL or non-finite
    components, another length than the most frequent one (the longer of two as frequent) or without an id link
    with nothing: no links, their own id, kept. Links are exact; a pair near the limit whose components no
    other link joins is missed with a probability of about MISS.
    """
    rows = _flagged(vectors, vec_id, embedding)
    classes = stored(
        rows.filter("h is not null").groupBy("h", "g", "e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
        .select("h", "g", F.struct("id", "h", "g").alias("node"), "n", "e"), "projection-classes")
    total = classes.count()
    pairs = _links(classes, passes or passes_for(total, limit, window), limit, window, block)
    joined = stored(connected_components(pairs), "projection-components")
    members = joined.join(classes.select("node", "n", "e"), "node").select("root", "node", "n", "e")
    counted = _counted(members, limit, cell).select("node", F.col("root")["id"].alias("root"), "links")
    alone = classes.filter("n > 1").join(joined.select("node"), "node", "left_anti").select(
        "node", F.col("node")["id"].alias("root"), (F.col("n") - 1).alias("links"))
    known = counted.unionByName(alone).select(
        F.col("node")["h"].alias("h"), F.col("node")["g"].alias("g"), "root", "links")
    component = F.coalesce("root", "vec_id")
    return rows.select("vec_id", "h", "g").join(known, ["h", "g"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
