"""Random forest of classes over rows that are equal once binned.

Trees compare bins only, so rows with the same bins and class are alike. A bootstrap gives each row a Poisson(1)
number of copies in each tree; the copies of n rows that are alike are then Poisson(n) together, which is drawn at
once. Passes visit the distinct binned rows, which stop growing when all combinations of bins are there.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..operators.step import StepModel
from ..session import let_workers_import, remove_path, scratch_path

CUT_ROWS = 10_000  # at least, that cuts are read from, as Spark's trees do
GROUPED_WIDTH = 64  # of wider vectors hardly any two are equal
LEAST_COPIES = 2  # rows for each distinct binned one
TREES_AT_ONCE = 8  # fits of one tree that run side by side
ROWS_A_TASK = 100_000


def cuts_of(values: np.ndarray, bins: int) -> list[float]:
    """Increasing cuts into *bins* bins at most: between all distinct values if they are few, else at quantiles."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = distinct[:-1] + (distinct[1:] - distinct[:-1]) / 2
    if len(middles) >= bins:
        at = np.searchsorted(np.cumsum(counts)[:-1], np.arange(1, bins) * len(values) / bins)
        middles = np.unique(middles[np.minimum(at, len(middles) - 1)])
    return middles.tolist()


class BinModel(StepModel):
    """Feature vector -> vector of bin numbers. State: the feature column and the cuts of each feature.

    A value equal to a cut is below it.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, cuts = self.fitted["name"], [np.array(x, float) for x in self.fitted["cuts"]]

        @F.pandas_udf("array<double>")
        def bins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            batch = np.vstack(x.to_numpy())
            return pd.Series(list(np.column_stack([np.searchsorted(k, batch[:, j]) for j, k in enumerate(cuts)]).astype(float)))

        return dataset.withColumn(name, array_to_vector(bins(vector_to_array(name))))


def bin_model(frame: DataFrame, features: str, rows: int, bins: int) -> BinModel:
    """Cuts from a bounded sample of the rows."""
    most = max(CUT_ROWS, bins * bins)
    sample = frame.select(vector_to_array(features).alias("x"))
    if rows > most:
        sample = sample.sample(False, most / rows, seed=42)
    table = np.vstack([r.x for r in sample.toLocalIterator()])
    return BinModel({"name": features, "cuts": [cuts_of(column, bins) for column in table.T]})


def repeats(frame: DataFrame, features: str, label: str, rows: int) -> bool:
    """Whether the rows of *frame* are LEAST_COPIES times their distinct ones or more."""
    found = frame.select(F.approx_count_distinct(F.xxhash64(vector_to_array(features), c(label)))).first()[0]
    return rows >= LEAST_COPIES * found


class GroupedForest(Estimator):
    """Spark's random forest of binned rows; *settings* are those of ``RandomForestClassifier`` but for the bootstrap."""

    def __init__(self, features: str, label: str, n_classes: int, trees: int, seed: int, leaf: int, settings: dict[str, Any]) -> None:
        super().__init__()
        self.features, self.label, self.n_classes = features, label, max(2, n_classes)
        self.trees, self.seed, self.leaf, self.settings = trees, seed, leaf, settings

    def bags(self, dataset: DataFrame) -> DataFrame:
        """The distinct rows with their number of copies in each tree: w0, w1, ..."""
        let_workers_import(dataset.sparkSession)
        trees, seed = self.trees, self.seed % (1 << 32)

        @F.pandas_udf("array<bigint>")
        def copies(key: pd.Series, n: pd.Series) -> pd.Series:
            # seeded by the row itself, so a task that runs again draws the same
            return pd.Series([
                np.random.default_rng([seed, k % (1 << 64)]).poisson(m, trees) for k, m in zip(key.tolist(), n.tolist())], dtype=object)

        return (
            dataset.groupBy(vector_to_array(self.features).alias("x"), c(self.label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
            .select("x", "y", "n", copies(F.xxhash64("x", "y"), "n").alias("w"))
            .select("x", "y", "n", *[F.col("w")[t].alias(f"w{t}") for t in range(trees)]))

    def _tree(self, rows: DataFrame, tree: int, total: int) -> Any:
        """One tree on the rows with its numbers of copies as weights."""
        label = F.col("y").alias(self.label, metadata={"ml_attr": {"type": "nominal", "num_vals": self.n_classes}})
        weight = F.col(f"w{tree}").cast("double").alias("_weight")
        frame = rows.filter(F.col(f"w{tree}") > 0).select(array_to_vector("x").alias(self.features), label, weight)
        # leaves are bounded by copies, as of a bootstrap, not by distinct rows
        least = (self.leaf - 0.5) / total if self.leaf > 1 else 0.0
        return RandomForestClassifier(
            numTrees=1, bootstrap=False, weightCol="_weight", minWeightFractionPerNode=least,
            **{**self.settings, "minInstancesPerNode": 1, "seed": self.seed + tree}).fit(frame)

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark = dataset.sparkSession
        path = scratch_path(spark, "bags")
        self.bags(dataset).write.parquet(path)
        rows = spark.read.parquet(path)
        totals = rows.agg(F.count(F.lit(1)), *[F.sum(f"w{t}") for t in range(self.trees)]).first()
        rows = rows.coalesce(1 + totals[0] // ROWS_A_TASK).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fit = inheritable_thread_target(spark)(lambda t: self._tree(rows, t, totals[1 + t]))
            with ThreadPool(min(TREES_AT_ONCE, self.trees)) as pool:
                fitted = pool.map(fit, range(self.trees), chunksize=1)
        finally:
            rows.unpersist()
            remove_path(spark, path)
        # one model of all trees: each is the only one of its forest
        trees = [m._java_obj.trees()[0] for m in fitted]
        java = spark._jvm.org.apache.spark.ml.classification
        model = RandomForestClassificationModel(JavaWrapper._new_java_obj(
            "org.apache.spark.ml.classification.RandomForestClassificationModel", fitted[0].uid,
            JavaWrapper._new_java_array(trees, java.DecisionTreeClassificationModel), fitted[0].numFeatures, self.n_classes))
        for name, value in {**self.settings, "numTrees": self.trees}.items():
            if name != "seed":
                model._java_obj.set(model._java_obj.getParam(name), value)
        model._transfer_params_from_java()
        return model
