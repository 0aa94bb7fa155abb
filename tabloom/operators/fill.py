"""Imputation steps: fill nulls with a training mean, median or mode."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ALL_CATEGORICAL, ALL_NUMERIC, c, is_numeric, replace_columns
from ..functions.quantiles import approx_quantiles
from ..functions.stats import TrainingStats, json_value, literal
from .step import Step, StepModel


def fill_nulls(df: DataFrame, values: dict[str, Any], double: bool = False) -> DataFrame:
    """Replace nulls of each column by its value; one projection.

    With *double* (means, medians) every column becomes a double, whatever its type and
    its value: the schema never follows the data. A value of None leaves the nulls.
    """
    types = {f.name: T.DoubleType() if double else f.dataType for f in df.schema.fields}
    new = {
        name: F.coalesce(c(name).cast(types[name]), literal(value, types[name]))
        for name, value in values.items() if name in types and (double or value is not None)}
    return replace_columns(df, new)


class FillModel(StepModel):
    """State: ``{"values": {column: fill value}, "double": bool}``; None leaves the nulls."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return fill_nulls(dataset, self.fitted["values"], self.fitted.get("double", False))

    def carry(self, stats: TrainingStats, schema: T.StructType) -> None:
        types = {f.name: f.dataType for f in schema.fields}
        for name, value in self.fitted["values"].items():
            if name in stats.frequencies and self.fitted.get("double"):
                stats.frequencies[name] = stats.frequencies[name].as_doubles()
            if value is None or name not in types:
                continue
            if name in stats.moments:
                if is_numeric(types[name]) and isinstance(value, (int, float)):
                    before = stats.moments[name]
                    stats.moments[name] = before.filled(float(value))
                    if before.present < before.rows:
                        stats.medians.pop(name, None)
                else:
                    stats.forget([name])
            else:
                stats.medians.pop(name, None)
            if name in stats.frequencies:
                filled = stats.frequencies[name].filled(value)
                if filled is None:
                    del stats.frequencies[name]
                else:
                    stats.frequencies[name] = filled


def _warn_empty(step: str, values: dict[str, Any]) -> None:
    empty = [name for name, value in values.items() if value is None]
    if empty:
        warnings.warn(f"{step}: columns without any value stay null: {empty}", UserWarning, stacklevel=3)


class MeanImpute(Step):
    """``mean_impute{cols="all_numeric"}``"""

    default_cols = ALL_NUMERIC

    def expect(self, stats):
        stats.expect("moments", self.columns(stats.df.schema))

    def learn(self, stats):
        cols = self.columns(stats.df.schema, warn=True)
        values = {name: m.mean for name, m in stats.need_moments(cols).items()}
        _warn_empty("MeanImpute", values)
        return FillModel({"values": values, "double": True})


class MedianImpute(Step):
    """``median_impute{cols="all_numeric", exact=True}``: exact, linearly interpolated median.

    ``exact=False`` takes a value near the middle from one scan (see ``approx_quantiles``).
    """

    default_cols = ALL_NUMERIC

    def expect(self, stats):
        if self.option("exact", True):
            stats.expect("medians", self.columns(stats.df.schema))

    def learn(self, stats):
        cols = self.columns(stats.df.schema, warn=True)
        if self.option("exact", True):
            values = stats.need_medians(cols)
        else:
            values = {name: found[0] for name, found in approx_quantiles(stats.df, cols, [0.5]).items()}
            stats.scans += 1
        _warn_empty("MedianImpute", values)
        return FillModel({"values": values, "double": True})


class ModeImpute(Step):
    """``mode_impute{cols="all_categorical"}``: most frequent value, smallest on ties."""

    default_cols = ALL_CATEGORICAL

    def expect(self, stats):
        stats.expect("frequencies", self.columns(stats.df.schema))

    def learn(self, stats):
        cols = self.columns(stats.df.schema, warn=True)
        found = stats.need_frequencies(cols, 1)
        values = {name: json_value(f.mode) for name, f in found.items()}
        _warn_empty("ModeImpute", values)
        return FillModel({"values": values})
