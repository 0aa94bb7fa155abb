"""Column steps: drop, select, rename."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from ..functions.columns import c
from .step import Step, StepModel


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    gone = set(cols)
    return df.select(*[c(n) for n in df.columns if n not in gone])


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    names = set(df.columns)
    return df.select(*[c(n) for n in cols if n in names])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[c(n).alias(mapping.get(n, n)) for n in df.columns])


class DropColumnsModel(StepModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return drop_columns(dataset, self.fitted["cols"])


class DropColumns(Step):
    """``drop_columns{cols}``: missing names warn at fit and are skipped after."""

    def learn(self, stats):
        return DropColumnsModel({"cols": self.columns(stats.df.schema, warn=True)})


class SelectColumnsModel(StepModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return select_columns(dataset, self.fitted["cols"])


class SelectColumns(Step):
    """``select_columns{cols}``: keep the listed columns, in the listed order.

    Excluded columns (target, keys) that are not listed are kept at the end.
    """

    def learn(self, stats):
        kept = self.columns(stats.df.schema, warn=True)
        protected = [n for n in self.option("exclude", []) if n in stats.df.columns and n not in kept]
        return SelectColumnsModel({"cols": kept + protected})


class RenameColumnsModel(StepModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return rename_columns(dataset, self.fitted["mapping"])

    def carry(self, stats, schema):
        mapping = self.fitted["mapping"]
        for known in (stats.moments, stats.frequencies, stats.medians):
            renamed = {mapping.get(n, n): v for n, v in known.items()}
            known.clear()
            known.update(renamed)


class RenameColumns(Step):
    """``rename_columns{mapping}``: old name -> new name, existing columns only."""

    def learn(self, stats):
        mapping = dict(self.option("mapping", {}))
        missing = [old for old in mapping if old not in stats.df.columns]
        if missing:
            warnings.warn(f"RenameColumns: columns not found and skipped: {missing}", UserWarning, stacklevel=2)
        return RenameColumnsModel({"mapping": {o: n for o, n in mapping.items() if o not in missing}})
