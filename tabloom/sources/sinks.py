"""Report writers: metrics as JSON, drift scores as an append-only table."""

from __future__ import annotations

import datetime
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import DriftReport
from ..session import local_frame


def save_metrics(spark: SparkSession, metrics: dict[str, Any], path: str) -> None:
    """One JSON record with the metrics dict, replacing an earlier report."""
    local_frame(spark, [(json.dumps(metrics, indent=None),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict[str, Any]:
    rows = spark.read.text(path).collect()
    return json.loads(rows[0][0])


def drift_rows(report: DriftReport, at: datetime.datetime, check_id: str | None = None) -> DataFrame:
    """Scores of one check with its id, time and verdict on every row."""
    return report.scores.select(
        F.lit(check_id or uuid.uuid4().hex).alias("check_id"),
        F.lit(at).cast("timestamp").alias("checked_at"),
        F.lit(at.date()).alias("check_date"),
        F.lit(report.status).alias("status"),
        "*",
    )


def append_drift(report: DriftReport, path: str, at: datetime.datetime | None = None) -> None:
    """Append a check to the drift log, partitioned by day."""
    rows = drift_rows(report, at or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))
    rows.write.mode("append").partitionBy("check_date").parquet(path)


def latest_drift(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of the newest check (per *by*); empty if nothing was logged."""
    keys = by or []
    newest = log.groupBy(*keys).agg(F.max(F.struct("checked_at", "check_id")).alias("_last"))
    if keys:
        joined = log.join(newest, keys)
    else:
        found = newest.first()
        last = found["_last"] if found is not None else None
        if last is None:
            return log.limit(0)
        return log.filter((F.col("checked_at") == F.lit(last["checked_at"])) & (F.col("check_id") == last["check_id"]))
    return joined.filter(
        (F.col("checked_at") == F.col("_last.checked_at")) & (F.col("check_id") == F.col("_last.check_id"))
    ).drop("_last")
