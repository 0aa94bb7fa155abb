"""Model quality as aggregations over a frame that has label and prediction."""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..session import local_frame

# Metric names and their short forms.
METRIC_ALIASES = {"f1": "f1_weighted", "precision": "precision_weighted", "recall": "recall_weighted"}
ERROR_METRICS = ("rmse", "mae")
NON_SCALAR_METRICS = ("task", "confusion_matrix")

DIGITS = 6
MAX_DENSE_CLASSES = 1000


def resolve_metric(metric: str) -> str:
    return METRIC_ALIASES.get(metric.lower(), metric.lower())


def lower_is_better(metric: str) -> bool:
    return metric.lower() in ERROR_METRICS


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction) pair that occurs."""
    return df.groupBy(c(label).alias("label"), c(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_list(counts: DataFrame, limit: int = MAX_DENSE_CLASSES) -> list[Any] | None:
    """Sorted union of labels and predictions; None if there are more than *limit*."""
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("k")).filter("k is not null").distinct()
    found = [r["k"] for r in classes.orderBy("k").limit(limit + 1).collect()]
    return found if len(found) <= limit else None


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", max_classes: int = MAX_DENSE_CLASSES,
) -> DataFrame:
    """Every (label, prediction) cell of the matrix, zeros included; only for up to *max_classes* classes.

    ``confusion_counts`` is the form for any number: the cells that occur.
    """
    counts = confusion_counts(df, label, prediction)
    classes = class_list(counts, max_classes)
    if classes is None:
        raise ValueError(f"more than {max_classes} classes; use confusion_counts, the long form")
    kind = counts.schema["label"].dataType
    every = F.array(*[F.lit(k).cast(kind) for k in classes])
    # one zero cell per class and column, merged with the counts by grouping
    zeros = local_frame(df.sparkSession, [(k,) for k in classes], f"label {kind.simpleString()}")
    zeros = zeros.select("label", F.explode(every).alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(zeros).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def _per_class(counts: DataFrame) -> DataFrame:
    """True positives, support and predicted rows per class."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("k"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
                 .alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("k"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return counts.select(F.explode(sides).alias("side")).groupBy("side.k").agg(
        F.sum("side.tp").alias("tp"), F.sum("side.support").alias("support"), F.sum("side.predicted").alias("predicted"))


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision, recall and f1; one row, 6 digits."""
    return metrics_of_counts(confusion_counts(df, label, prediction))


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """The same from counted (label, prediction) pairs."""
    classes = _per_class(counts)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    total = F.sum(support)

    def weighted(value):
        return F.round(F.sum(support * value) / total, DIGITS)

    return classes.agg(
        F.round(F.sum(tp) / total, DIGITS).alias("accuracy"),
        weighted(_ratio(2 * tp, support + predicted)).alias("f1_weighted"),
        weighted(_ratio(tp, predicted)).alias("precision_weighted"),
        weighted(_ratio(tp, support)).alias("recall_weighted"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mae, rmse and r2 in one aggregate; one row, 6 digits."""
    y, p = c(label).cast("double"), c(prediction).cast("double")
    both = y.isNotNull() & p.isNotNull()
    err = F.when(both, y - p)
    spread = F.var_pop(F.when(both, y)) * F.count(err)
    residual = F.sum(err * err)
    # a constant label has no spread: perfect predictions score 1, others 0
    r2 = F.when(spread == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(residual, spread))
    return df.agg(
        F.round(F.avg(F.abs(err)), DIGITS).alias("mae"),
        F.round(F.sqrt(F.avg(err * err)), DIGITS).alias("rmse"),
        F.round(r2, DIGITS).alias("r2"),
    )


def evaluate(
    df: DataFrame, task: str, label: str = "label", prediction: str = "prediction", max_classes: int = MAX_DENSE_CLASSES,
) -> dict[str, Any]:
    """Metrics as a dict; classification adds the nested confusion matrix of up to *max_classes* classes.

    Rows are scored once: they are counted per (label, prediction), and all else follows from those counts.
    With more classes there is no nested matrix; ``confusion_counts`` gives its cells as a table.
    """
    if task == "regression":
        return {"task": task, **regression_metrics(df, label, prediction).first().asDict()}
    if task != "classification":
        raise TypeError(f"Cannot evaluate task '{task}'; expected classification or regression")
    counts = confusion_counts(df, label, prediction).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        metrics = {"task": task, **metrics_of_counts(counts).first().asDict()}
        classes = class_list(counts, max_classes)
        if classes is not None:
            place = {k: i for i, k in enumerate(classes)}
            matrix = [[0] * len(classes) for _ in classes]
            for r in counts.filter("label is not null and prediction is not null").collect():
                matrix[place[r["label"]]][place[r["prediction"]]] = r["n"]
            metrics["confusion_matrix"] = matrix
    finally:
        counts.unpersist()
    return metrics
