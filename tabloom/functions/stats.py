"""Per-column training statistics, how to compute them, and how they carry over.

A fitting step needs means, spreads, extremes or category counts of its input
columns. When steps are chained, the statistics of a step's *output* usually
follow from those of its input by arithmetic: filling k nulls with a constant,
an affine rescale, or an indicator of a category all have closed forms. Keeping
those up to date lets a chain of steps be fitted with one scan of the training
data per kind of statistic instead of one scan per step.
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import c, is_numeric, to_double
from .quantiles import exact_quantiles


# Value groups per column when its most frequent values are looked for.
HEAD_GROUPS = 128


@dataclass(frozen=True)
class Moments:
    """Row count, non-null count and moments of one numeric column."""

    rows: int
    present: int
    mean: float | None
    var: float | None          # population variance
    lo: float | None
    hi: float | None

    @property
    def std(self) -> float | None:
        if self.var is None:
            return None
        return 0.0 if self.lo == self.hi else math.sqrt(self.var)

    def filled(self, value: float) -> "Moments":
        """Moments after every null is replaced by *value*."""
        missing = self.rows - self.present
        if missing == 0:
            return self
        if self.present == 0:
            return Moments(self.rows, self.rows, value, 0.0, value, value)
        share = missing / self.rows
        delta = value - self.mean
        return Moments(
            self.rows,
            self.rows,
            self.mean + delta * share,
            self.var * (1 - share) + delta * delta * share * (1 - share),
            min(self.lo, value),
            max(self.hi, value),
        )

    def affine(self, shift: float, scale: float) -> "Moments":
        """Moments of ``(x - shift) / scale`` for a positive *scale*."""
        if self.mean is None:
            return self
        return replace(
            self,
            mean=(self.mean - shift) / scale,
            var=self.var / (scale * scale),
            lo=(self.lo - shift) / scale,
            hi=(self.hi - shift) / scale,
        )

    @staticmethod
    def constant(rows: int, value: float) -> "Moments":
        return Moments(rows, rows, value, 0.0, value, value)

    @staticmethod
    def of_counts(counts: Iterable[tuple[float, int]]) -> "Moments":
        """Moments of a column given as (value, rows) pairs without nulls."""
        pairs = [(v, n) for v, n in counts if n > 0]
        rows = sum(n for _, n in pairs)
        mean = sum(v * n for v, n in pairs) / rows
        var = sum((v - mean) ** 2 * n for v, n in pairs) / rows
        return Moments(rows, rows, mean, var, min(v for v, _ in pairs), max(v for v, _ in pairs))


@dataclass(frozen=True)
class Frequencies:
    """Most frequent values of one column, most frequent first, ties by value.

    ``values`` is the whole distribution when ``complete``; otherwise only its
    head, and the column has more distinct values than were asked for.
    """

    nulls: int
    values: tuple[tuple[Any, int], ...]
    complete: bool

    @property
    def mode(self) -> Any:
        return self.values[0][0] if self.values else None

    def filled(self, value: Any) -> "Frequencies | None":
        """Counts after every null is replaced by *value*; None if they can't be told from the head."""
        if self.nulls == 0:
            return self
        counts = dict(self.values)
        if not self.complete and value not in counts:
            return None
        counts[value] = counts.get(value, 0) + self.nulls
        return Frequencies(0, order_counts(counts), self.complete)

    def as_doubles(self) -> "Frequencies":
        """Counts of the column cast to double; values that become equal are added up."""
        counts: dict[float, int] = {}
        for v, n in self.values:
            counts[float(v)] = counts.get(float(v), 0) + n
        return replace(self, values=order_counts(counts))


def order_counts(counts: Mapping[Any, int]) -> tuple[tuple[Any, int], ...]:
    return tuple(sorted(counts.items(), key=lambda item: (-item[1], item[0])))


def moments(df: DataFrame, cols: Iterable[str]) -> dict[str, Moments]:
    """Moments of all *cols* in one shuffle-free aggregate."""
    names = list(cols)
    if not names:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        v = to_double(c(name), types[name])
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.var_pop(v).alias(f"var{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        name: Moments(row["rows"], row[f"n{i}"], row[f"mean{i}"], row[f"var{i}"], row[f"lo{i}"], row[f"hi{i}"])
        for i, name in enumerate(names)
    }


def value_slots(col: Column, dtype: T.DataType) -> list[Column]:
    """A value as a (text, integer, double) triple, so unlike columns share one job."""
    none = [F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")]
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        slot, value = 1, col.cast("bigint")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        slot, value = 2, col.cast("double")
    else:
        slot, value = 0, col.cast("string")
    none[slot] = value
    return [none[0].alias("s"), none[1].alias("l"), none[2].alias("d")]


def long_values(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Unpivot *cols* to rows ``(i, s, l, d)``; ``i`` is the position in *cols*."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [
        F.struct(F.lit(i).alias("i"), *value_slots(c(name), types[name]))
        for i, name in enumerate(cols)
    ]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def python_value(row: Any, dtype: T.DataType) -> Any:
    if isinstance(dtype, T.BooleanType):
        return None if row["l"] is None else bool(row["l"])
    if row["l"] is not None:
        return row["l"]
    return row["d"] if row["d"] is not None else row["s"]


def frequencies(df: DataFrame, limits: Mapping[str, int]) -> dict[str, Frequencies]:
    """The most frequent values of every column in *limits*, in one job.

    Rows are counted per (column, value) with map-side combining, so a value
    that fills a third of the table is no hot spot; only the head of each
    column (its limit, plus one to see whether there is more) leaves Spark.
    """
    names = list(limits)
    if not names:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = long_values(df, names).groupBy("i", "s", "l", "d").agg(F.count(F.lit(1)).alias("n"))
    is_null = F.col("s").isNull() & F.col("l").isNull() & F.col("d").isNull()
    order = [is_null.desc(), F.col("n").desc(), F.col("s"), F.col("l"), F.col("d")]
    keep = F.element_at(F.array(*[F.lit(limits[name] + 2) for name in names]), F.col("i") + 1)
    # heads of value groups first, so that a column with very many values is
    # never ranked in one task; then the head of those heads
    group = F.pmod(F.hash("s", "l", "d"), F.lit(HEAD_GROUPS))
    heads = counts.withColumn("pos", F.row_number().over(Window.partitionBy("i", group).orderBy(*order)))
    heads = heads.filter(F.col("pos") <= keep)
    top = heads.withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy(*order)))
    rows = top.filter(F.col("pos") <= keep).collect()

    nulls = dict.fromkeys(names, 0)
    values: dict[str, list[tuple[Any, int]]] = {name: [] for name in names}
    for row in sorted(rows, key=lambda r: (r["i"], r["pos"])):
        name = names[row["i"]]
        if row["s"] is None and row["l"] is None and row["d"] is None:
            nulls[name] = row["n"]
        else:
            values[name].append((python_value(row, types[name]), row["n"]))
    out = {}
    for name in names:
        found, limit = values[name], limits[name]
        out[name] = Frequencies(nulls[name], tuple(found[:limit]), len(found) <= limit)
    return out


def literal(value: Any, dtype: T.DataType) -> Column:
    """A fitted value as a literal of the column's own type."""
    return F.lit(value).cast(dtype)


def json_value(value: Any) -> Any:
    """Fitted values are kept as JSON; anything but text, numbers and booleans as text."""
    if isinstance(value, (decimal.Decimal, datetime.date, datetime.datetime)):
        return str(value)
    return value


class TrainingStats:
    """Lazily computed statistics of the training frame while steps are fitted.

    ``expect`` registers what later steps will ask for, so that the first miss
    computes everything in one pass. ``move`` follows the frame through a
    fitted step, keeping what the step says still holds.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.moments: dict[str, Moments] = {}
        self.frequencies: dict[str, Frequencies] = {}
        self.medians: dict[str, float | None] = {}
        self._want_moments: set[str] = set()
        self._want_limits: dict[str, int] = {}
        self._want_medians: set[str] = set()
        self.scans = 0

    def expect(self, kind: str, cols: Iterable[str], limit: int = 1) -> None:
        names = [name for name in cols if name in self.df.columns]
        if kind == "moments":
            self._want_moments.update(names)
        elif kind == "medians":
            self._want_medians.update(names)
        else:
            for name in names:
                self._want_limits[name] = max(limit, self._want_limits.get(name, 0))

    def need_moments(self, cols: Iterable[str]) -> dict[str, Moments]:
        names = list(cols)
        if any(name not in self.moments for name in names):
            types = {f.name: f.dataType for f in self.df.schema.fields}
            wanted = {
                name for name in {*names, *self._want_moments}
                if name in types and name not in self.moments
                and (is_numeric(types[name]) or isinstance(types[name], T.BooleanType))
            }
            self.moments.update(moments(self.df, sorted(wanted)))
            self.scans += 1
        return {name: self.moments[name] for name in names}

    def need_medians(self, cols: Iterable[str]) -> dict[str, float | None]:
        names = list(cols)
        if any(name not in self.medians for name in names):
            wanted = {n for n in {*names, *self._want_medians} if n in self.df.columns and n not in self.medians}
            found = exact_quantiles(self.df, sorted(wanted), [0.5])
            self.medians.update({name: values[0] for name, values in found.items()})
            self.scans += 1
        return {name: self.medians[name] for name in names}

    def need_frequencies(self, cols: Iterable[str], limit: int) -> dict[str, Frequencies]:
        names = list(cols)

        def enough(name: str, size: int) -> bool:
            known = self.frequencies.get(name)
            return known is not None and (known.complete or len(known.values) >= size)

        if any(not enough(name, limit) for name in names):
            wanted = {n: s for n, s in self._want_limits.items() if n in self.df.columns and not enough(n, s)}
            wanted.update({n: max(limit, wanted.get(n, 0)) for n in names if not enough(n, limit)})
            self.frequencies.update(frequencies(self.df, wanted))
            self.scans += 1
        return {name: self.frequencies[name] for name in names}

    def forget(self, names: Iterable[str]) -> None:
        for name in names:
            self.moments.pop(name, None)
            self.frequencies.pop(name, None)
            self.medians.pop(name, None)

    def move(self, df: DataFrame) -> None:
        """Continue on the transformed frame."""
        self.df = df
        alive = set(df.columns)
        for known in (self.moments, self.frequencies, self.medians):
            for name in [n for n in known if n not in alive]:
                del known[name]
        self._want_moments &= alive
        self._want_medians &= alive
        self._want_limits = {n: s for n, s in self._want_limits.items() if n in alive}
