"""Hyperparameter search: seeded random samples, each fitted and scored on validation rows."""

from __future__ import annotations

import math
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import evaluate, lower_is_better, resolve_metric
from ..session import local_frame
from .models import FEATURES, LABEL, Trainer, model_kind, save_model
from .runlog import RunLog

# Parameter ranges of the searchable models.
_FOREST = {
    "n_estimators": ("int", 50, 300),
    "max_depth": ("int", 3, 20),
    "min_samples_split": ("int", 2, 10),
}
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "logistic_regression": {
        "C": ("loguniform", 0.01, 10.0),
        "max_iter": ("int", 100, 1000),
        "solver": ("choice", ["lbfgs", "liblinear"]),
    },
    "random_forest": _FOREST,
    "random_forest_classifier": _FOREST,
    "random_forest_regressor": _FOREST,
    "decision_tree": {"max_depth": ("int", 3, 20), "min_samples_split": ("int", 2, 10)},
    "ridge": {"alpha": ("loguniform", 0.001, 100.0)},
    "lasso": {"alpha": ("loguniform", 0.0001, 10.0)},
    "svc": {"C": ("loguniform", 0.01, 10.0)},
    "robust_regression": {"C": ("loguniform", 0.01, 10.0), "epsilon": ("uniform", 1.05, 2.5)},
}


def search_space(model_type: str) -> dict[str, tuple]:
    name = model_type.lower()
    if name not in SEARCH_SPACES:
        raise ValueError(
            f"'{model_type}' has no search space; known ones: {sorted(SEARCH_SPACES)}")
    return SEARCH_SPACES[name]


def _draw(rng: random.Random, kind: str, *bounds: Any) -> Any:
    if kind == "loguniform":
        return math.exp(rng.uniform(math.log(bounds[0]), math.log(bounds[1])))
    if kind == "uniform":
        return rng.uniform(*bounds)
    if kind == "int":
        return rng.randint(*bounds)
    if kind == "choice":
        return rng.choice(bounds[0])
    raise ValueError(f"unknown parameter kind '{kind}'")


def sample_params(space: dict[str, tuple], n_trials: int, seed: int = 42) -> list[dict[str, Any]]:
    """*n_trials* independent draws; trial i does not depend on how many there are."""
    return [
        {name: _draw(random.Random(f"{seed}|{i}|{name}"), *spec) for name, spec in space.items()}
        for i in range(n_trials)
    ]


@dataclass(frozen=True)
class Trial:
    number: int
    value: float | None            # None unless the trial is complete
    params: dict[str, Any]
    metrics: dict[str, Any]
    model: PipelineModel | None
    seconds: float
    run_id: str
    state: str = "COMPLETE"


class Tuner:
    """Random search over a model's space.

    Feature vectors of both parts are built and kept once; up to *parallel*
    trials run as concurrent Spark jobs and share the executors.
    """

    def __init__(self, model_type: str, n_trials: int = 20, metric: str | None = None, direction: str | None = None,
                 seed: int = 42, parallel: int = 2, space: dict[str, tuple] | None = None,
                 run_log: RunLog | None = None, model_dir: str | None = None, tags: dict[str, str] | None = None,
                 dataset_path: str = "") -> None:
        self.model_type = model_type
        self.task = model_kind(model_type).task
        self.metric = metric or ("f1" if self.task == "classification" else "rmse")
        if direction not in (None, "minimize", "maximize"):
            raise ValueError("direction must be 'minimize' or 'maximize'")
        self.direction = direction or ("minimize" if lower_is_better(self.metric) else "maximize")
        self.space = space if space is not None else search_space(model_type)
        self.n_trials, self.seed, self.parallel = n_trials, seed, parallel
        self.run_log, self.model_dir, self.tags = run_log, model_dir, dict(tags or {})
        self.dataset_path = dataset_path
        self.trials: list[Trial] = []

    def score(self, metrics: dict[str, Any]) -> float:
        for name in (self.metric, resolve_metric(self.metric)):
            if name in metrics:
                return float(metrics[name])
        raise ValueError(f"the trial has no metric '{self.metric}', only {sorted(metrics)}")

    def tune(self, train: DataFrame, val: DataFrame, target: str = "target", exclude: list[str] | None = None,
             pipeline_summary: list | None = None) -> Trial:
        base = Trainer(self.model_type, {}, target, exclude or [])
        (index, assemble, names), ready, info = base.prepare(train)
        ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
        checked = assemble.transform(index.transform(val)).select(FEATURES, LABEL, target)
        checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
        val_rows = checked.count()

        def run(number: int, params: dict[str, Any]) -> Trial:
            started = time.time()
            stages = Trainer(self.model_type, params, target, exclude or []).fit_prepared(ready, info)
            scored = PipelineModel([*stages, names]).transform(checked)
            metrics = evaluate(scored, self.task, target, "prediction")
            model = PipelineModel([index, assemble, *stages, names])
            return Trial(number, self.score(metrics), params, metrics, model, time.time() - started, str(uuid.uuid4()))

        drawn = sample_params(self.space, self.n_trials, self.seed)
        self.trials, errors = [], []
        try:
            with ThreadPoolExecutor(max_workers=self.parallel) as pool:
                waiting = {pool.submit(run, k, params): (k, params) for k, params in enumerate(drawn)}
                # each trial is logged when it ends, so a later failure loses none
                for done in as_completed(waiting):
                    number, params = waiting[done]
                    error = done.exception()
                    if error is None:
                        trial = done.result()
                    else:
                        errors.append(error)
                        trial = Trial(number, None, params, {}, None, 0.0, str(uuid.uuid4()), "FAIL")
                    self.trials.append(trial)
                    if self.run_log is not None:
                        self._log(trial, info.rows, val_rows, pipeline_summary or [])
        finally:
            self.trials.sort(key=lambda t: t.number)
            ready.unpersist()
            checked.unpersist()
        if errors and len(errors) == len(self.trials):
            raise errors[0]
        return self.best()

    def _log(self, t: Trial, train_rows: int, val_rows: int, summary: list) -> None:
        path = f"{self.model_dir.rstrip('/')}/{t.run_id}" if self.model_dir and t.model is not None else ""
        if path:
            save_model(t.model, path)
        self.run_log.log_run(
            run_id=t.run_id, model_type=self.model_type, metrics=t.metrics, model_path=path,
            config={"model": {"type": self.model_type, "params": t.params}}, pipeline_summary=summary,
            dataset_path=self.dataset_path, train_rows=train_rows, test_rows=val_rows, duration_seconds=t.seconds,
            tags={"type": "trial", "trial_number": str(t.number), "state": t.state, **self.tags})

    def best(self) -> Trial:
        """Best value of the complete trials in the search direction; the earliest trial on ties."""
        sign = 1 if self.direction == "minimize" else -1
        return min((t for t in self.trials if t.value is not None), key=lambda t: (sign * t.value, t.number))

    def trials_frame(self, train: DataFrame) -> DataFrame:
        rows = [(t.number, t.state, t.value, {k: str(v) for k, v in t.params.items()}) for t in self.trials]
        return local_frame(train.sparkSession, rows, "trial int, state string, value double, params map<string,string>")


def study_summary(trials: DataFrame, params: list[str]) -> DataFrame:
    """Completed trials, one column per parameter."""
    done = trials.filter(F.col("state") == "COMPLETE")
    return done.select("trial", "value", *[F.try_element_at("params", F.lit(p)).alias(p) for p in params])
