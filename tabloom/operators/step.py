"""Base classes of the feature steps.

A step is a Spark ML ``Estimator``; fitting it gives a ``Model`` whose whole
state is one small JSON-able dict and whose ``transform`` is a projection.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import resolve_columns
from ..functions.stats import TrainingStats


class NotFittedError(RuntimeError):
    """Raised when an unfitted step or pipeline is asked to transform."""


class StepModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted step. Columns missing from the frame are skipped."""

    state: Param = Param(Params._dummy(), "state", "fitted state, JSON-able")

    def __init__(self, state: dict[str, Any] | None = None) -> None:
        super().__init__()
        self._set(state=state or {})

    @property
    def fitted(self) -> dict[str, Any]:
        return self.getOrDefault(self.state)

    def carry(self, stats: TrainingStats, schema: T.StructType) -> None:
        """Update *stats* of the input frame (*schema*) to hold for the output."""


class Step(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An unfitted step, configured by keyword arguments.

    ``cols``     list of names, or ``"all_numeric"`` / ``"all_categorical"``
    ``exclude``  columns the sentinels never pick (target and key columns)
    """

    config: Param = Param(Params._dummy(), "config", "step settings")
    default_cols: str | list[str] = []

    def __init__(self, **config: Any) -> None:
        super().__init__()
        if isinstance(config.get("exclude"), tuple):
            config["exclude"] = list(config["exclude"])
        self._set(config=config)

    def option(self, name: str, default: Any = None) -> Any:
        return self.getOrDefault(self.config).get(name, default)

    def columns(self, schema: T.StructType, warn: bool = False) -> list[str]:
        return resolve_columns(
            schema,
            self.option("cols", self.default_cols),
            self.option("exclude", []),
            type(self).__name__ if warn else None,
        )

    def expect(self, stats: TrainingStats) -> None:
        """Register the statistics :meth:`learn` will need, where already known."""

    def learn(self, stats: TrainingStats) -> StepModel:
        """Build the fitted model from (lazily computed) training statistics."""
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> StepModel:
        return self.learn(TrainingStats(dataset))

    def transform(self, dataset: DataFrame, params: Any = None) -> DataFrame:
        raise NotFittedError(f"{type(self).__name__} is not fitted; call fit() on training data first")
