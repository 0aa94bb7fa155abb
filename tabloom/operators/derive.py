"""Derived features: log1p and polynomial terms."""

from __future__ import annotations

import warnings
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, replace_columns, to_double
from ..functions.stats import TrainingStats
from .step import Step, StepModel


def negative_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows below zero per column: one row, one column per input column."""
    return df.agg(*[F.count_if(c(n) < 0).alias(n) for n in cols])


def log_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """log1p in place; NULL at and below -1, where it is not a finite number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return replace_columns(df, {n: F.log1p(to_double(c(n), types[n])) for n in cols if n in types})


def polynomial_columns(df: DataFrame, cols: list[str], degree: int = 2) -> DataFrame:
    """Append powers 2..degree of each column, then the product of every pair."""
    types = {f.name: f.dataType for f in df.schema.fields}
    value = {n: to_double(c(n), types[n]) for n in cols if n in types}
    added = {f"{n}^{k}": F.pow(v, F.lit(float(k))) for n, v in value.items() for k in range(2, degree + 1)}
    added.update({f"{a}*{b}": value[a] * value[b] for a, b in combinations(value, 2)})
    clash = [n for n in added if n in types]
    if clash:
        raise ValueError(f"polynomial feature names already exist: {clash}")
    return df.select(*[c(n) for n in df.columns], *[v.alias(n) for n, v in added.items()])


class LogModel(StepModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return log_columns(dataset, self.fitted["cols"])

    def carry(self, stats, schema):
        stats.forget(self.fitted["cols"])


class LogTransform(Step):
    """``log_transform{cols}``; warns about columns that hold negative values."""

    def expect(self, stats: TrainingStats) -> None:
        stats.expect("moments", self.columns(stats.df.schema))

    def learn(self, stats):
        cols = self.columns(stats.df.schema, warn=True)
        negative = [n for n, m in stats.need_moments(cols).items() if m.lo is not None and m.lo < 0]
        if negative:
            warnings.warn(f"LogTransform: columns with negative values: {negative}", UserWarning, stacklevel=2)
        return LogModel({"cols": cols})


class PolynomialModel(StepModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return polynomial_columns(dataset, self.fitted["cols"], self.fitted["degree"])


class PolynomialFeatures(Step):
    """``polynomial_features{cols, degree=2}``"""

    def learn(self, stats):
        degree = int(self.option("degree", 2))
        return PolynomialModel({"cols": self.columns(stats.df.schema, warn=True), "degree": degree})
