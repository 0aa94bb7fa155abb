"""End-to-end experiment, champion scoring, and drift against the champion's data."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..operators.clean import Cleaner
from ..operators.drift import DriftReport, detect_drift
from ..operators.evaluate import evaluate
from ..operators.split import part, split_exact, split_hash
from ..sources.readers import load
from ..sources.sinks import save_metrics
from .features import FeaturePipeline
from .models import Trainer, load_model, save_model
from .runlog import RunLog
from .tuning import Tuner


@dataclass(frozen=True)
class ExperimentResult:
    run_id: str
    model: PipelineModel           # feature steps and model in one
    metrics: dict[str, Any]
    rows: dict[str, int]
    predictions: DataFrame         # test rows with key, target and prediction


def split_by_spec(df: DataFrame, key: list[str], target: str, spec: dict[str, Any]) -> DataFrame:
    common = {
        "test_size": spec.get("test_size", 0.2), "val_size": spec.get("val_size", 0.1),
        "seed": spec.get("random_seed", 42), "target": target,
    }
    stratify = bool(spec.get("stratify", False))
    mode = spec.get("mode", "exact" if stratify else "hash")
    if mode == "exact":
        return split_exact(df, key, stratify=stratify, **common)
    if mode != "hash":
        raise ValueError(f"unknown split mode '{mode}'; use 'hash' or 'exact'")
    return split_hash(df, key, **common)


def run_experiment(
    df: DataFrame,
    spec: dict[str, Any],
    key: list[str],
    run_log: RunLog | None = None,
    model_dir: str | None = None,
    report_path: str | None = None,
) -> ExperimentResult:
    """clean (optional) -> split -> fit steps on train -> train or tune -> evaluate -> log.

    *spec* sections: ``data.target_col``, ``cleaning``, ``splitting``,
    ``pipeline.steps``, ``model{type,params}``, ``tuning{n_trials,metric,direction}``, ``tags``.
    """
    started = time.time()
    target = spec["data"]["target_col"]
    require_columns(df, [target], "Target column")
    if "cleaning" in spec:
        df = Cleaner(spec["cleaning"]).clean(df)
    parts = split_by_spec(df, key, target, spec.get("splitting", {})).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        train, val, test = (part(parts, name) for name in ("train", "val", "test"))
        kept = [*key, target]
        steps = FeaturePipeline(spec.get("pipeline", {}).get("steps", []), exclude=kept).fit(train)
        model_spec = spec["model"]
        tuning = spec.get("tuning")
        if tuning:
            tuner = Tuner(
                model_spec["type"], tuning.get("n_trials", 20), tuning.get("metric"), tuning.get("direction"),
                seed=spec.get("splitting", {}).get("random_seed", 42), parallel=tuning.get("parallel", 2),
                space=tuning.get("space"), run_log=run_log, model_dir=model_dir, tags=spec.get("tags"),
                dataset_path=spec["data"].get("filepath", ""))
            best = tuner.tune(steps.transform(train), steps.transform(val), target, key)
            params, fitted, task = best.params, best.model, tuner.task
        else:
            params = model_spec.get("params", {})
            trainer = Trainer(model_spec["type"], params, target, key)
            fitted, task = trainer.fit(steps.transform(train)), trainer.task
        whole = PipelineModel([*steps.stages, *fitted.stages])
        predictions = whole.transform(test).select(*key, target, "prediction")
        metrics = evaluate(predictions, task, target, "prediction")
    finally:
        parts.unpersist()

    run_id = str(uuid.uuid4())
    path = ""
    if model_dir is not None:
        path = f"{model_dir.rstrip('/')}/{run_id}"
        save_model(whole, path)
    if report_path is not None:
        save_metrics(df.sparkSession, metrics, report_path)
    if run_log is not None:
        run_log.log_run(
            run_id=run_id, config={**spec, "model": {**model_spec, "params": params}},
            pipeline_summary=spec.get("pipeline", {}).get("steps", []), metrics=metrics,
            model_type=model_spec["type"], model_path=path, dataset_path=spec["data"].get("filepath", ""),
            train_rows=sizes.get("train", 0), test_rows=sizes.get("test", 0),
            duration_seconds=time.time() - started, tags={"type": "final", **spec.get("tags", {})})
    return ExperimentResult(run_id, whole, metrics, sizes, predictions)


def batch_predict(run_log: RunLog, df: DataFrame, key: list[str]) -> DataFrame:
    """Score a frame with the champion: key, prediction, and which model it was."""
    champion = run_log.champion()
    if champion is None or not champion["model_path"]:
        raise FileNotFoundError("no run with a model has been promoted")
    return score(load_model(champion["model_path"]), df, key, champion["run_id"], champion["model_type"])


def score(model: PipelineModel, df: DataFrame, key: list[str], run_id: str = "unknown",
          model_type: str = "unknown") -> DataFrame:
    return model.transform(df).select(
        *key, "prediction", F.lit(run_id).alias("model_run_id"), F.lit(model_type).alias("model_type"))


def drift_from_champion(spark: SparkSession, run_log: RunLog, new: DataFrame, key: list[str] | None = None,
                        reference_split: str = "all") -> DriftReport:
    """Compare *new* with the data the champion was built from.

    The whole dataset is the reference; ``reference_split="train"`` takes only
    the rows the champion was fitted on (found again from the seed and *key*).
    """
    champion = run_log.champion()
    if champion is None or not champion["dataset_path"]:
        raise FileNotFoundError("No champion run with a dataset. Promote a run first.")
    reference = load(spark, champion["dataset_path"])
    if reference_split != "all":
        if not key:
            raise ValueError("reference_split needs the key columns of the split")
        config = champion["config"]
        parts = split_by_spec(reference, key, config["data"]["target_col"], config.get("splitting", {}))
        reference = part(parts, reference_split)
    return detect_drift(reference, new)
