"""Exact quantiles whose state stays bounded however many distinct values there are.

``percentile`` keeps a value -> count map in one task, so on a column of
continuous values it grows with the data. Here a KLL sketch first narrows each
quantile to a bracket ``[lo, hi]``. Clamping the column to the bracket keeps the
wanted order statistics and folds all other rows into two values, so the exact
``percentile`` of the clamped column needs a map no larger than the bracket.
Every pass is one aggregate over all columns without a shuffle of rows. Brackets
are verified by counting, so the result equals ``percentile`` exactly whatever
the sketch returned.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import c, to_double

GRID = 1000
SKETCH_K = 8192
# About three times the rank error of a sketch of that size.
MARGIN = 0.001
# Entries all exact maps of one pass may hold together.
MAX_STATE = 2_000_000
# Never split the allowance further; a bracket must hold the two ranks it interpolates.
MIN_STATE = 16
# Sketches of many tasks are merged in this many groups before the last merge.
MERGE_GROUPS = 256


def sketch_grids(df: DataFrame, values: Sequence[Column], steps: int, k: int = SKETCH_K,
                 extra: Sequence[Column] = (), probs: Sequence[float] | None = None) -> Any:
    """One row: ``n{i}``, ``lo{i}``, ``hi{i}`` and the quantile grid ``g{i}`` of each value (at *probs* if given).

    Task sketches are merged in two levels, so that no task receives one sketch
    from every task of a large scan. *extra* aggregates must be named and additive.
    """
    named = df.select(
        F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_group"),
        *[v.alias(f"v{i}") for i, v in enumerate(values)], *extra)
    names = [n for n in named.columns if n != "_group" and not n.startswith("v")]
    idx = range(len(values))
    parts = named.groupBy("_group").agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in idx],
        *[F.min(f"v{i}").alias(f"lo{i}") for i in idx],
        *[F.max(f"v{i}").alias(f"hi{i}") for i in idx],
        *[F.kll_sketch_agg_double(f"v{i}", k).alias(f"s{i}") for i in idx],
        *[F.sum(n).alias(n) for n in names])
    merged = parts.agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in idx],
        *[F.min(f"lo{i}").alias(f"lo{i}") for i in idx],
        *[F.max(f"hi{i}").alias(f"hi{i}") for i in idx],
        *[F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}"))).alias(f"s{i}") for i in idx],
        *[F.sum(n).alias(n) for n in names])
    probs = [i / steps for i in range(steps + 1)] if probs is None else list(probs)
    ranks = F.from_json(F.lit(json.dumps(probs)), "array<double>")
    return merged.select(
        *[F.coalesce(F.col(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in idx],
        *[F.col(f"lo{i}") for i in idx], *[F.col(f"hi{i}") for i in idx],
        *[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", ranks)).alias(f"g{i}") for i in idx],
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]).first()


def approx_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], k: int = SKETCH_K,
) -> dict[str, list[float | None]]:
    """Values of the column at about the wanted ranks, from merged sketches: one scan, whatever the data.

    With the default *k* a rank is off by at most MARGIN of the rows, but for odds of about one in a thousand.
    Nulls are skipped; all-null gives None.
    """
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    row = sketch_grids(df, [to_double(c(n), types[n]) for n in cols], 1, k, probs=probs)
    return {n: list(row[f"g{i}"]) if row[f"n{i}"] else [None] * len(probs) for i, n in enumerate(cols)}


@dataclass
class _Bracket:
    col: str
    prob: float
    lo: float
    hi: float
    inside: int            # about this many rows lie strictly between lo and hi
    margin: float = MARGIN

    def ranks(self, n: int) -> tuple[int, int]:
        position = self.prob * (n - 1)
        return math.floor(position), math.ceil(position)


def _narrow(grid: Sequence[float], first: int, last: int, m: int, margin: float) -> tuple[float, float]:
    """Grid values that enclose the ranks *first*..*last* among *m* sorted rows."""
    left = math.floor(((first / m) - margin) * GRID)
    right = math.ceil((((last + 1) / m) + margin) * GRID)
    return grid[max(left, 0)], grid[min(right, GRID)]


def _width(m: int, margin: float) -> int:
    return min(m, math.ceil(m * (3.0 / GRID + 4 * margin)) + 2)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    max_state: int = MAX_STATE,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, nulls skipped; all-null gives None."""
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    value = {name: to_double(c(name), types[name]) for name in cols}

    row = sketch_grids(df, [value[n] for n in cols], GRID)
    counts: dict[str, int] = {}
    extremes: dict[str, tuple[float, float]] = {}
    result: dict[tuple[str, float], float | None] = {}
    todo: list[_Bracket] = []
    for i, name in enumerate(cols):
        n = counts[name] = row[f"n{i}"]
        lo, hi = extremes[name] = (row[f"lo{i}"], row[f"hi{i}"])
        for p in probs:
            if n == 0:
                result[name, p] = None
                continue
            b = _Bracket(name, p, lo, hi, _width(n, MARGIN))
            b.lo, b.hi = _narrow([lo, *row[f"g{i}"][1:-1], hi], *b.ranks(n), n, MARGIN)
            todo.append(b)

    while todo:
        limit = max(max_state // len(todo), MIN_STATE)
        row = _measure(df, value, todo, limit)
        again: list[_Bracket] = []
        for i, b in enumerate(todo):
            n = counts[b.col]
            k1, k2 = b.ranks(n)
            start, inside = row[f"uptolo{i}"], row[f"inside{i}"]
            if not (row[f"below{i}"] <= k1 and k2 < row[f"upto{i}"]):
                # the sketch was off by more than its margin: bracket again, wider
                b.margin *= 8
                b.lo, b.hi = extremes[b.col]
                # beyond any use of a sketch: the exact value over the full range
                b.inside = n if b.margin <= 0.5 else 0
                again.append(b)
            elif b.inside <= limit:
                result[b.col, b.prob] = row[f"exact{i}"]
            elif k2 < start:
                result[b.col, b.prob] = b.lo
            elif k1 >= start + inside:
                result[b.col, b.prob] = b.hi
            elif inside <= limit:
                b.inside = inside
                again.append(b)
            else:
                # sorted order: rows below lo, equal to lo, strictly inside, equal to hi
                first, last = max(k1 - start, 0), min(k2 - start, inside - 1)
                lo, hi = _narrow([b.lo, *row[f"grid{i}"][1:-1], b.hi], first, last, inside, b.margin)
                b.lo = lo if k1 >= start else b.lo
                b.hi = hi if k2 < start + inside else b.hi
                b.inside = _width(inside, b.margin)
                again.append(b)
        todo = again
    return {name: [result[name, p] for p in probs] for name in cols}


def _measure(df: DataFrame, value: dict[str, Column], todo: Sequence[_Bracket], limit: int) -> dict[str, Any]:
    """Counts around every bracket; the quantile itself if narrow enough, else a finer grid."""
    aggs: list[Column] = []
    wide: list[int] = []
    for i, b in enumerate(todo):
        v, lo, hi = value[b.col], F.lit(float(b.lo)), F.lit(float(b.hi))
        aggs += [
            F.count_if(v < lo).alias(f"below{i}"),
            F.count_if(v <= lo).alias(f"uptolo{i}"),
            F.count_if(v <= hi).alias(f"upto{i}"),
            F.count_if((v > lo) & (v < hi)).alias(f"inside{i}"),
        ]
        if b.inside <= limit:
            clamped = F.when(v.isNotNull(), F.greatest(F.least(v, hi), lo))
            aggs.append(F.percentile(clamped, b.prob).alias(f"exact{i}"))
        else:
            wide.append(i)
    found = df.agg(*aggs).first().asDict()
    if wide:
        inner = []
        for i in wide:
            b = todo[i]
            v = value[b.col]
            inner.append(F.when((v > F.lit(float(b.lo))) & (v < F.lit(float(b.hi))), v))
        grids = sketch_grids(df, inner, GRID)
        found.update({f"grid{i}": grids[f"g{j}"] for j, i in enumerate(wide)})
    return found
