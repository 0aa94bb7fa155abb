"""Feature pipelines from a list of step dicts."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import TrainingStats
from ..operators.derive import LogTransform, PolynomialFeatures
from ..operators.encode import LabelEncode, OneHotEncode
from ..operators.fill import MeanImpute, MedianImpute, ModeImpute
from ..operators.project import DropColumns, RenameColumns, SelectColumns
from ..operators.rescale import MinMaxScale, StandardScale
from ..operators.step import NotFittedError, Step, StepModel
from ..session import local_frame

# The registered step names.
STEPS: dict[str, type] = {
    "drop_columns": DropColumns,
    "select_columns": SelectColumns,
    "rename_columns": RenameColumns,
    "mean_impute": MeanImpute,
    "median_impute": MedianImpute,
    "mode_impute": ModeImpute,
    "onehot_encode": OneHotEncode,
    "label_encode": LabelEncode,
    "standard_scale": StandardScale,
    "minmax_scale": MinMaxScale,
    "log_transform": LogTransform,
    "polynomial_features": PolynomialFeatures,
}


def register_step(name: str, cls: type) -> None:
    """Add a custom step: any Estimator class taking its settings as keywords."""
    STEPS[name] = cls


def make_step(spec: dict[str, Any], exclude: Iterable[str] = ()) -> Estimator:
    settings = dict(spec)
    name = settings.pop("type", "")
    if name not in STEPS:
        raise ValueError(f"Unknown step '{name}'. Available steps: {sorted(STEPS)}")
    if exclude and issubclass(STEPS[name], Step):
        settings.setdefault("exclude", list(exclude))
    return STEPS[name](**settings)


class FeaturePipeline(Estimator):
    """Ordered steps; ``fit(train)`` returns a Spark ML ``PipelineModel``.

    *exclude* names columns that sentinels never pick (target and keys).
    Statistics are shared between steps: what a step needs is computed for all
    steps at once, and carried through the fitted steps where it follows.
    """

    def __init__(self, steps: list[dict[str, Any]], exclude: Iterable[str] = ()) -> None:
        super().__init__()
        self.exclude = list(exclude)
        self.specs = [dict(s) for s in steps]
        self.stages = [make_step(s, self.exclude) for s in self.specs]
        self.training_scans = 0

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stats = TrainingStats(dataset)
        fitted = []
        for i, stage in enumerate(self.stages):
            if isinstance(stage, Step):
                for later in self.stages[i:]:
                    if isinstance(later, Step):
                        later.expect(stats)
                model = stage.learn(stats)
            else:
                model = stage.fit(stats.df)
            schema = stats.df.schema
            out = model.transform(stats.df)
            if isinstance(model, StepModel):
                model.carry(stats, schema)
                stats.move(out)
            else:
                scans = stats.scans
                stats = TrainingStats(out)
                stats.scans = scans
            fitted.append(model)
        self.training_scans = stats.scans
        return PipelineModel(fitted)

    def fit_transform(self, dataset: DataFrame) -> DataFrame:
        return self.fit(dataset).transform(dataset)

    def transform(self, dataset: DataFrame, params: Any = None) -> DataFrame:
        raise NotFittedError("the pipeline is not fitted; call fit() on training data first")


def shape_summary(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Columns before and after every step, and the row count (no step changes it).

    Column counts come from the schemas; the rows are counted once.
    """
    rows, current = [], df
    for i, stage in enumerate(model.stages):
        after = stage.transform(current)
        rows.append((i, type(stage).__name__, len(current.columns), len(after.columns)))
        current = after
    steps = local_frame(df.sparkSession, rows, "step int, name string, columns_in int, columns_out int")
    return steps.withColumn("row_count", F.lit(df.count()).cast("bigint"))


def preview(steps: list[dict[str, Any]], df: DataFrame, key: list[str], n: int = 20,
            exclude: Iterable[str] = ()) -> DataFrame:
    """Fit and apply on the first *n* rows by *key* only; statistics are those rows'."""
    head = df.orderBy(*key).limit(n)
    return FeaturePipeline(steps, [*exclude, *key]).fit(head).transform(head)


def feature_columns(schema: T.StructType, exclude: Iterable[str]) -> list[str]:
    """Columns a model can use: numeric, boolean and vector ones, sorted by name."""
    skip = set(exclude)
    return sorted(
        f.name for f in schema.fields
        if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType, VectorUDT))
    )
