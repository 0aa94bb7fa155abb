"""Whitening by the exact spectrum of the integer scatter of all distinct vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import c, finite, fold_partitions, map_batches, matrix, stored
from .exact_spectrum import eigenpairs

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
WHOLE = 1 << 53  # whole numbers below it are exact as doubles
LONG = 1 << 63


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): vectors as whole numbers, of the most frequent length (the longer of two as frequent)."""
    rows = vectors.filter(F.coalesce(finite(c(embedding)), F.lit(False))).select(
        c(vec_id).alias("vec_id"), c(embedding).cast("array<double>").alias("e"))
    width = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("e") == (width.d if width else 0)).select(
        "vec_id", F.transform("e", lambda v: F.floor(F.lit(float(SCALE)) * v) + OFFSET).alias("x"))


def _centred(column: pa.Array, middle: list[int]) -> np.ndarray:
    """x less *middle*: as doubles where products of them are exact, else as Python integers."""
    x = matrix(column)
    if np.abs(x).max(initial=0) < WHOLE and max(map(abs, middle), default=0) < WHOLE:
        z = (x - np.array(middle, np.int64)).astype(np.float64)
        if np.abs(z).max(initial=0) < 1 << 26:
            return z
    return x.astype(object) - np.array(middle, dtype=object)


def _scatter(rows: DataFrame, middle: list[int]) -> list[list[int]]:
    """Exact sums of products of centred entries over all *rows*; only dimension squared sums leave Spark."""
    d = len(middle)
    above = [(i, j) for i in range(d) for j in range(i, d)]

    def fold(batches: Iterator[pa.RecordBatch]) -> dict:
        total = np.zeros((d, d), object)
        for batch in batches:
            z = _centred(batch.column(0), middle)
            if z.dtype == object:
                total += z.T @ z
                continue
            most = max(1, int(np.abs(z).max(initial=0)) ** 2)
            step = max(1, (WHOLE - 1) // most)  # so many rows cannot leave the exact doubles
            for at in range(0, len(z), step):
                part = z[at:at + step]
                total += (part.T @ part).astype(np.int64).astype(object)
        return {"i": [i for i, _ in above], "j": [j for _, j in above], "v": [Decimal(int(total[i, j])) for i, j in above]}

    parts = fold_partitions(rows.select("x"), fold, "i int, j int, v decimal(38,0)")
    out = [[0] * d for _ in range(d)]
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i][row.j] = out[row.j][row.i] = int(row.v)
    return out


class Whitener:
    """n and S of the distinct vectors, and the components with a positive eigenvalue."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]], middle: list[int], components: int) -> None:
        self.n, self.middle = n, middle
        self.left = [s - n * m for s, m in zip(sums, middle)]  # sums of the centred entries
        # n squared times the covariance, in integers
        m = np.array([[n * v - a * b for v, b in zip(row, self.left)] for row, a in zip(scatter, self.left)], dtype=object)
        pairs = eigenpairs(m.reshape(len(sums), len(sums)), components)
        trace = sum(int(m[i, i]) for i in range(len(sums)))
        self.vectors = np.array([v for _, v in pairs]).reshape(len(pairs), len(sums))
        self.deviations = np.array([float(e.sqrt() / n) for e, _ in pairs])
        self.explained = [float(e / trace) for e, _ in pairs]

    def centre(self, column: pa.Array) -> np.ndarray:
        return _centred(column, self.middle)

    def whiten(self, z: np.ndarray) -> np.ndarray:
        means = np.array([s / self.n for s in self.left])
        return (z.astype(np.float64) - means) @ self.vectors.T / self.deviations

    def deviation(self, z: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2; NULL where one does not fit a long."""
        big = self.n * max(1, int(np.abs(z).max(initial=0))) + max(map(abs, self.left), default=0)
        kind = np.int64 if z.shape[1] * big * big < LONG else object
        whole = z.astype(np.int64) if z.dtype != object else z
        diff = self.n * whole.astype(kind) - np.array(self.left, dtype=kind)
        return [int(v) if v < LONG else None for v in (diff * diff).sum(1)]


def fit_whitener(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitener | None, DataFrame]:
    """The whitener of (x) rows and the table of distinct vectors it was fitted on."""
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None, fit
    sums = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(first.d)]).first()
    n, s = sums[0], [int(v) for v in sums[1:]]
    middle = [(2 * v + n) // (2 * n) for v in s]
    return Whitener(n, s, _scatter(fit, middle), middle, components), fit


def _identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, by size."""
    k = len(model.explained)

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        n, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whiten(model.centre(batch.column(0)))
            n, sums, products = n + len(w), sums + w.sum(0), products + w.T @ w
        return {"n": [n], "s": [sums.tolist()], "p": [products.ravel().tolist()]} if n else None

    parts = fold_partitions(fit, fold, "n bigint, s array<double>, p array<double>")
    total = parts.agg(*[F.sum(F.col("s")[i]) for i in range(k)], *[F.sum(F.col("p")[i]) for i in range(k * k)]).first()
    means = np.array(total[:k]) / model.n
    covariance = np.array(total[k:]).reshape(k, k) / model.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten_vectors(
    vectors: DataFrame, *, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component.

    Entries count as x = floor(64 * entry) + 1000000. The fit list holds each distinct vector once, so copies
    weigh nothing; every row gets its results, also one without an id or with a repeated id. Rows with a
    NULL vector, NULL or non-finite entries or another length than the most frequent one are left out. Only
    components with a positive eigenvalue exist: a table without two different vectors gives no row.
    Equal eigenvalues share a space, in which the components are one orthonormal choice. ``deviation``
    is NULL where it exceeds a long.
    """
    rows = _usable(vectors, vec_id, embedding)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    model, fit = fit_whitener(rows, components)
    k = len(model.explained) if model else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, model)

    def run(batch: pa.RecordBatch) -> dict:
        z = model.centre(batch.column(1))
        m = len(z)
        every = pa.array(np.repeat(np.arange(m), k))
        return {
            "vec_id": batch.column(0).take(every), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
            "n": np.full(m * k, model.n), "deviation": pa.array(model.deviation(z), pa.int64()).take(every),
            "whitened": model.whiten(z).ravel(), "explained": np.tile(model.explained, m),
            "identity_error": np.full(m * k, error)}

    return map_batches(rows, run, schema, rows=2_048)
