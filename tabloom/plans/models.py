"""Model registry on Spark ML.

Parameters keep their familiar names; each entry maps them to the Spark
estimator so that the objective is the same where Spark has the model. Fitting
gives one ``PipelineModel`` from the feature columns to a ``prediction`` column
holding values of the original target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, replace_columns, require_columns
from ..functions.ranking import sorted_positions
from ..functions.stats import frequencies, json_value, literal, moments
from ..operators.step import StepModel
from ..session import scratch_path
from .features import feature_columns
from .grouped_forest import GROUPED_WIDTH, GroupedForest, bin_model, repeats
from .wide_ridge import WideRidge, vector_width

FEATURES, LABEL = "_features", "_label"
MAX_CLASSES = 1000  # more of them are kept in a table that is joined
NORMAL_FEATURES = 4096  # of Spark's solver by normal equations
MAX_DEPTH = 30  # of Spark's trees
GROUPED_ROWS = 400_000  # from which forests look for rows that are equal once binned


@dataclass(frozen=True)
class TrainingInfo:
    """What a parameter mapping may depend on."""

    rows: int
    label_std: float           # population deviation of a regression label
    n_classes: int
    frame: DataFrame           # the prepared training rows


@dataclass(frozen=True)
class ModelKind:
    task: str
    build: Callable[[dict[str, Any], TrainingInfo], list[Any]]


def _known(params: dict[str, Any], allowed: Iterable[str]) -> None:
    extra = set(params) - set(allowed)
    if extra:
        raise ValueError(f"unsupported model parameters: {sorted(extra)}")


def _logistic(params, info):
    _known(params, ["C", "max_iter", "solver", "tol", "random_state"])
    return [LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, family="auto", standardization=False, elasticNetParam=0.0,
        regParam=1.0 / (float(params.get("C", 1.0)) * info.rows),
        maxIter=int(params.get("max_iter", 100)), tol=float(params.get("tol", 1e-8)))]


def _linear(penalty_mix: float, reg: Callable[[float, TrainingInfo], float], solver: str):
    def build(params, info):
        _known(params, ["alpha", "max_iter", "tol", "random_state"])
        return [LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, elasticNetParam=penalty_mix, standardization=False, solver=solver,
            regParam=reg(float(params.get("alpha", 1.0)), info),
            maxIter=int(params.get("max_iter", 1000)), tol=float(params.get("tol", 1e-10)))]

    return build


def _seed(params: dict[str, Any]) -> int:
    return 42 if params.get("random_state") is None else int(params["random_state"])


def _tree_params(params: dict[str, Any]) -> dict[str, Any]:
    depth = MAX_DEPTH if params.get("max_depth") is None else int(params["max_depth"])
    if depth > MAX_DEPTH:
        raise ValueError(f"max_depth may be {MAX_DEPTH} at most, not {depth}")
    leaf = max(int(params.get("min_samples_leaf", 1)), max(1, int(params.get("min_samples_split", 2)) // 2))
    return {
        "featuresCol": FEATURES, "labelCol": LABEL, "maxDepth": depth,
        "minInstancesPerNode": leaf, "maxBins": int(params.get("max_bins", 64)), "seed": _seed(params),
    }


# a prediction needs neither the votes nor the probabilities of all classes, which are a vector of every class in every row
_NO_VOTES = {"rawPredictionCol": "", "probabilityCol": ""}
_TREE = ["max_depth", "max_bins", "min_samples_split", "min_samples_leaf", "random_state"]


def _tree(params, info):
    _known(params, _TREE)
    return [DecisionTreeClassifier(impurity="gini", **_tree_params(params), **_NO_VOTES)]


def _grouped_forest(info: TrainingInfo, trees: int, settings: dict[str, Any]) -> list[Any]:
    """Bins and a forest on distinct binned rows; nothing if rows are few copies of each other."""
    first = info.frame.select(vector_width(FEATURES).alias("d")).first()
    leaf = settings["minInstancesPerNode"]
    if first is None or not 0 < first.d <= GROUPED_WIDTH or info.rows < 8 * leaf:
        return []
    bins = bin_model(info.frame, FEATURES, info.rows, settings["maxBins"])
    if not repeats(bins.transform(info.frame), FEATURES, LABEL, info.rows):
        return []
    return [bins, GroupedForest(FEATURES, LABEL, info.n_classes, trees, settings["seed"], leaf, settings)]


def _forest(cls, subset: str):
    def build(params, info):
        _known(params, [*_TREE, "n_estimators"])
        votes = _NO_VOTES if cls is RandomForestClassifier else {}
        trees, settings = int(params.get("n_estimators", 100)), {"featureSubsetStrategy": subset, **_tree_params(params), **votes}
        if cls is RandomForestClassifier and info.rows >= GROUPED_ROWS:
            grouped = _grouped_forest(info, trees, settings)
            if grouped:
                return grouped
        return [cls(numTrees=trees, **settings)]

    return build


class FourierModel(StepModel):
    """Random Fourier features of the feature vector, for an RBF kernel.

    State: the feature count, gamma and a seed. The projection matrix (features times
    components doubles) is drawn from the seed on the driver and travels with the
    function. One Arrow batch is one matrix product.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.fitted
        rng = np.random.default_rng(s["seed"])
        weights = rng.normal(0.0, np.sqrt(2.0 * s["gamma"]), (s["n_features"], s["n_components"]))
        phases = rng.uniform(0.0, 2 * np.pi, s["n_components"])
        scale = np.sqrt(2.0 / s["n_components"])

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            batch = np.vstack(x.to_numpy()) if len(x) else np.empty((0, weights.shape[0]))
            return pd.Series(list(scale * np.cos(batch @ weights + phases)))

        return dataset.withColumn(FEATURES, array_to_vector(project(vector_to_array(FEATURES))))


def _gamma(params: dict[str, Any], frame: DataFrame, n_features: int) -> float:
    """"scale" is 1 / (features * variance over all entries), "auto" 1 / features."""
    gamma = params.get("gamma", "scale")
    if gamma == "auto":
        return 1.0 / n_features
    if gamma != "scale":
        return float(gamma)
    x = vector_to_array(FEATURES)
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
    row = frame.agg(F.avg(total / n_features).alias("mean"), F.avg(squares / n_features).alias("square")).first()
    variance = row["square"] - row["mean"] ** 2
    return 1.0 / (n_features * variance) if variance > 0 else 1.0


def _kernel(params: dict[str, Any], info: TrainingInfo) -> list[Any]:
    kernel = params.get("kernel", "rbf")
    if kernel == "linear":
        return []
    if kernel != "rbf":
        raise ValueError(f"unsupported kernel '{kernel}'; use 'rbf' or 'linear'")
    width = info.frame.select(F.size(vector_to_array(FEATURES))).first()[0]
    return [FourierModel({
        "n_features": width, "n_components": int(params.get("n_components", 128)),
        "gamma": _gamma(params, info.frame, width), "seed": _seed(params)})]


def _svc(params, info):
    _known(params, ["C", "kernel", "gamma", "n_components", "max_iter", "tol", "random_state"])
    svm = LinearSVC(
        featuresCol=FEATURES, labelCol=LABEL, standardization=False,
        regParam=1.0 / (float(params.get("C", 1.0)) * info.rows),
        maxIter=int(params.get("max_iter", 100)), tol=float(params.get("tol", 1e-6)))
    if info.n_classes > 2:
        svm = OneVsRest(classifier=svm, featuresCol=FEATURES, labelCol=LABEL)
    return [*_kernel(params, info), svm]


def _robust(params, info):
    _known(params, ["C", "epsilon", "kernel", "gamma", "n_components", "max_iter", "tol", "random_state"])
    epsilon = float(params.get("epsilon", 1.35))
    if epsilon <= 1:
        raise ValueError(f"epsilon must be above 1, not {epsilon}")
    return [*_kernel(params, info), LinearRegression(
        featuresCol=FEATURES, labelCol=LABEL, loss="huber", standardization=False, solver="l-bfgs",
        epsilon=epsilon,
        regParam=1.0 / (float(params.get("C", 1.0)) * info.rows),
        maxIter=int(params.get("max_iter", 200)), tol=float(params.get("tol", 1e-6)))]


def _ridge(params, info):
    """The same objective by normal equations, which divide the penalty by the deviation of the label, or step by step."""
    first = info.frame.select(vector_width(FEATURES).alias("d")).first()
    if first is None or first.d <= NORMAL_FEATURES:
        return _linear(0.0, lambda alpha, info: alpha * info.label_std / info.rows, "normal")(params, info)
    _known(params, ["alpha", "max_iter", "tol", "random_state"])
    return [WideRidge(
        FEATURES, LABEL, float(params.get("alpha", 1.0)), int(params.get("max_iter", 1000)), float(params.get("tol", 1e-10)))]


_lasso = _linear(1.0, lambda alpha, info: alpha, "l-bfgs")

# The registered model names.
MODELS: dict[str, ModelKind] = {
    "logistic_regression": ModelKind("classification", _logistic),
    "random_forest_classifier": ModelKind("classification", _forest(RandomForestClassifier, "sqrt")),
    "random_forest_regressor": ModelKind("regression", _forest(RandomForestRegressor, "all")),
    "random_forest": ModelKind("classification", _forest(RandomForestClassifier, "sqrt")),
    "decision_tree": ModelKind("classification", _tree),
    "ridge": ModelKind("regression", _ridge),
    "lasso": ModelKind("regression", _lasso),
    "svc": ModelKind("classification", _svc),
    "robust_regression": ModelKind("regression", _robust),
}


def register_model(name: str, task: str, build: Callable[[dict[str, Any], TrainingInfo], list[Any]]) -> None:
    """Add a model: *build* returns the Spark ML stages that end in an estimator."""
    MODELS[name] = ModelKind(task, build)


def model_kind(name: str) -> ModelKind:
    if name not in MODELS:
        raise ValueError(f"no model is called '{name}'; known: {sorted(MODELS)}")
    return MODELS[name]


def class_table(train: DataFrame, target: str) -> str:
    """Distinct target values with their rank, written in the shared folder: a class index of any size."""
    path = scratch_path(train.sparkSession, "classes")
    sorted_positions(train.select(c(target).alias("value")), "value", "code", path)
    return path


class ClassIndexModel(StepModel):
    """Target value -> class index (null when unknown).

    State: column, and the classes as a list, or as a table if there are more than MAX_CLASSES.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        target, classes = self.fitted["target"], self.fitted["classes"]
        if target not in dataset.columns:      # scoring frames have no target
            return dataset
        if self.fitted.get("tables"):
            table = dataset.sparkSession.read.parquet(self.fitted["tables"][target]["path"]).select(
                F.col("value").alias("_class"), F.col("code").cast("double").alias(LABEL))
            return dataset.join(table, c(target) == F.col("_class"), "left").drop("_class")
        dtype = dataset.schema[target].dataType
        if classes is None:
            return dataset.withColumn(LABEL, c(target).cast("double"))
        known = F.array(*[literal(k, dtype) for k in classes])
        position = F.nullif(F.array_position(known, c(target)), F.lit(0).cast("bigint"))
        return dataset.withColumn(LABEL, (position - 1).cast("double"))


class VectorColumnModel(StepModel):
    """One vector column as the feature vector. State: its name and size.

    ``VectorAssembler`` names every slot in the schema, which is as long as the vectors.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, size = self.fitted["name"], self.fitted["size"]
        fits = F.coalesce(vector_width(name) == size, F.lit(False))
        wrong = F.raise_error(F.lit(f"column {name} must hold vectors of {size} entries"))
        return dataset.withColumn(FEATURES, F.when(fits, c(name)).otherwise(wrong))


class ClassNameModel(StepModel):
    """Class index in ``prediction`` -> target value; drops the working columns."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, dtype = self.fitted["classes"], T.StructType.fromDDL(f"x {self.fitted['dtype']}")["x"].dataType
        out = dataset.drop(FEATURES, LABEL, "rawPrediction", "probability")
        if self.fitted.get("tables"):
            (info,) = self.fitted["tables"].values()
            table = out.sparkSession.read.parquet(info["path"]).select(
                F.col("code").alias("_code"), F.col("value").alias("_class"))
            named = out.withColumn("_at", F.col("prediction").cast("bigint")).join(table, F.col("_at") == F.col("_code"), "left")
            return named.select(*[
                F.col("_class").alias("prediction") if n == "prediction" else c(n) for n in out.columns])
        if classes is None:
            return out
        names = F.array(*[literal(k, dtype) for k in classes])
        return replace_columns(out, {"prediction": F.element_at(names, F.col("prediction").cast("int") + 1)})


class Trainer:
    """``Trainer(model_type, params).fit(train)`` -> PipelineModel."""

    def __init__(self, model_type: str, params: dict[str, Any] | None = None, target: str = "target",
                 exclude: Iterable[str] = ()) -> None:
        self.kind = model_kind(model_type)
        self.model_type, self.params = model_type, dict(params or {})
        self.target, self.exclude = target, list(exclude)

    @property
    def task(self) -> str:
        return self.kind.task

    def prepare(self, train: DataFrame) -> tuple[list[Model], DataFrame, TrainingInfo]:
        """Label and vector stages, the prepared rows, and what the mappings need."""
        require_columns(train, [self.target], "Target column")
        dtype = train.schema[self.target].dataType
        features = feature_columns(train.schema, [self.target, *self.exclude])
        classes: list[Any] | None = None
        tables: dict[str, Any] = {}
        n_classes, std = 0, 0.0
        if self.task == "classification":
            present = train.filter(c(self.target).isNotNull())
            found = frequencies(present, {self.target: MAX_CLASSES})[self.target]
            if found.complete:
                classes = [json_value(v) for v in sorted(v for v, _ in found.values)]
                rows, n_classes = sum(n for _, n in found.values), len(classes)
            else:
                path = class_table(present, self.target)
                rows, n_classes = present.count(), train.sparkSession.read.parquet(path).count()
                tables = {self.target: {"path": path, "size": n_classes}}
        else:
            m = moments(train, [self.target])[self.target]
            rows, std = m.present, m.std or 0.0
        index = ClassIndexModel({"target": self.target, "classes": classes, "tables": tables})
        assemble = self.assembler(train, features)
        label = F.col(LABEL)
        if n_classes:
            # Spark infers the number of classes from the rows only up to 100 of them
            label = label.alias(LABEL, metadata={"ml_attr": {"type": "nominal", "num_vals": max(2, n_classes)}})
        ready = assemble.transform(index.transform(train)).filter(F.col(LABEL).isNotNull()).select(FEATURES, label)
        info = TrainingInfo(rows, std, n_classes, ready)
        names = ClassNameModel({"classes": classes, "dtype": dtype.simpleString(), "tables": tables})
        return [index, assemble, names], ready, info

    def assembler(self, train: DataFrame, features: list[str]) -> Any:
        if len(features) == 1 and isinstance(train.schema[features[0]].dataType, VectorUDT):
            (name,) = features
            size = train.schema[name].metadata.get("ml_attr", {}).get("num_attrs")
            if size is None:
                first = train.select(vector_width(name).alias("d")).first()
                size = first.d if first is not None else None
            if size is not None and size > NORMAL_FEATURES:
                return VectorColumnModel({"name": name, "size": size})
        return VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="error")

    def fit(self, train: DataFrame) -> PipelineModel:
        (index, assemble, names), ready, info = self.prepare(train)
        ready.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return PipelineModel([index, assemble, *self.fit_prepared(ready, info), names])
        finally:
            ready.unpersist()

    def fit_prepared(self, ready: DataFrame, info: TrainingInfo) -> list[Any]:
        fitted, frame = [], ready
        for stage in self.kind.build(self.params, info):
            model = stage.fit(frame) if isinstance(stage, Estimator) else stage
            if isinstance(stage, StepModel):
                frame = stage.transform(frame)
            fitted.append(model)
        return fitted


def _with_tables(stage: Any, place: Callable[[str, str], str]) -> Any:
    """The stage with each category table's path replaced by ``place(column, path)``."""
    if not (isinstance(stage, StepModel) and stage.fitted.get("tables")):
        return stage
    tables = {n: {**info, "path": place(n, info["path"])} for n, info in stage.fitted["tables"].items()}
    return type(stage)({**stage.fitted, "tables": tables})


def save_model(model: PipelineModel, path: str) -> None:
    """Save the model with copies of its category tables, so that the folder is all that scoring needs."""
    root, tables = path.rstrip("/"), {}
    spark = SparkSession.active()

    def inside(i: int) -> Callable[[str, str], str]:
        def place(name: str, source: str) -> str:
            target = f"tables/{i}-{len(tables)}"
            tables[target] = spark.read.parquet(source)
            return target

        return place

    stages = [_with_tables(stage, inside(i)) for i, stage in enumerate(model.stages)]
    PipelineModel(stages).write().overwrite().save(root)
    for target, table in tables.items():
        table.write.parquet(f"{root}/{target}")


def load_model(path: str) -> PipelineModel:
    root = path.rstrip("/")
    try:
        model = PipelineModel.load(root)
    except Exception as error:
        if "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"there is no model at {path}") from error
        raise
    return PipelineModel([_with_tables(stage, lambda _, inner: f"{root}/{inner}") for stage in model.stages])
