"""Scaling steps: standard score and min-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ALL_NUMERIC, c, replace_columns, to_double
from ..functions.stats import Moments, TrainingStats
from .step import Step, StepModel


def rescale(col: Column, shift: float | None, scale: float | None) -> Column:
    """``(x - shift) / scale``; a constant column is 0.0 on every row, nulls included."""
    if shift is None or scale is None:
        return F.lit(None).cast("double")
    if scale == 0.0:
        return F.lit(0.0)
    return (col - F.lit(float(shift))) / F.lit(float(scale))


class RescaleModel(StepModel):
    """State: ``{"params": {column: [shift, scale]}}``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in dataset.schema.fields}
        return replace_columns(dataset, {
            name: rescale(to_double(c(name), types[name]), shift, scale)
            for name, (shift, scale) in self.fitted["params"].items() if name in types
        })

    def carry(self, stats: TrainingStats, schema: T.StructType) -> None:
        for name, (shift, scale) in self.fitted["params"].items():
            known = stats.moments.get(name)
            stats.forget([name])
            if known is None or known.mean is None or shift is None:
                continue
            if scale == 0.0:
                stats.moments[name] = Moments.constant(known.rows, 0.0)
            else:
                stats.moments[name] = known.affine(shift, scale)


class _Scale(Step):
    default_cols = ALL_NUMERIC

    def expect(self, stats):
        stats.expect("moments", self.columns(stats.df.schema))

    def params(self, m: Moments) -> list[float | None]:
        raise NotImplementedError

    def learn(self, stats):
        found = stats.need_moments(self.columns(stats.df.schema, warn=True))
        return RescaleModel({"params": {name: self.params(m) for name, m in found.items()}})


class StandardScale(_Scale):
    """``standard_scale{cols="all_numeric"}``: mean 0, population deviation 1 on train."""

    def params(self, m):
        return [m.mean, m.std]


class MinMaxScale(_Scale):
    """``minmax_scale{cols="all_numeric"}``: train range to [0, 1], no clipping."""

    def params(self, m):
        return [m.lo, None if m.lo is None else m.hi - m.lo]
