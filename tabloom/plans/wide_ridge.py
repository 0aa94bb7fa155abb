"""Ridge regression with any number of features: no vector of all features is in one place.

Minimises the sum of squares of ``y - b - w x`` plus *alpha* times that of the weights by conjugate
gradients on the centred normal equations, divided by their diagonal. Weights, residuals and directions are
tables with one row per feature, and a step is two joins with the non-zero entries. Rows with
equal features count as one row with a weight.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..operators.step import StepModel
from ..session import remove_path, scratch_path

# A smaller residual, relative to that of no weights, is below the rounding of doubles.
LEAST_TOL = 1e-13


def vector_width(name: str) -> Column:
    """Entries of a vector, zeros included."""
    v = F.unwrap_udt(c(name))
    return F.when(v["type"] == 0, v["size"]).otherwise(F.size(v["values"]))


def vector_entries(name: str) -> Column:
    """The non-zero entries of a vector as structs of feature number and value."""
    v = F.unwrap_udt(c(name))
    pairs = F.when(v["type"] == 0, F.arrays_zip(v["indices"].alias("j"), v["values"].alias("v"))).otherwise(
        F.transform(v["values"], lambda x, i: F.struct(i.alias("j"), x.alias("v"))))
    return F.filter(pairs, lambda e: e["v"] != 0)


class WideRidgeModel(StepModel):
    """Adds ``prediction``. State: features column, intercept and the table of weights (feature number, weight)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.fitted
        weights = dataset.sparkSession.read.schema("j int, w double").parquet(s["tables"]["weights"]["path"])
        # rows are numbered before their entries are listed, not with them
        numbered = dataset.select(
            F.struct(*[c(n) for n in dataset.columns]).alias("row"), F.monotonically_increasing_id().alias("i"),
            vector_entries(s["features"]).alias("x"))
        rows = numbered.select("row", "i", F.explode_outer("x").alias("e")).select("row", "i", "e.j", "e.v")
        scored = rows.join(weights, "j", "left").groupBy("i").agg(
            F.first("row").alias("row"), F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("z"))
        return scored.select("row.*", (F.coalesce("z", F.lit(0.0)) + s["intercept"]).alias("prediction"))


class WideRidge(Estimator):
    def __init__(self, features: str, label: str, alpha: float, max_iter: int, tol: float) -> None:
        super().__init__()
        if alpha < 0:
            raise ValueError(f"alpha must not be negative, as {alpha} is")
        self.features, self.label, self.alpha, self.max_iter, self.tol = features, label, alpha, max_iter, max(tol, LEAST_TOL)

    def _fit(self, dataset: DataFrame) -> WideRidgeModel:
        spark, used = dataset.sparkSession, []

        def kept(df: DataFrame, name: str) -> DataFrame:
            used.append(scratch_path(spark, name))
            df.write.parquet(used[-1])
            return spark.read.schema(df.schema).parquet(used[-1])

        row = dataset.agg(F.count(c(self.label)).alias("n"), F.avg(self.label).alias("mean")).first()
        n, mean = row.n, row.mean or 0.0
        entries = kept(
            dataset.select(vector_entries(self.features).alias("x"), (c(self.label) - mean).alias("y"))
            .groupBy("x").agg(F.count("y").alias("rows"), F.sum("y").alias("y"))
            .select(F.monotonically_increasing_id().alias("i"), "rows", "y", "x")
            .select("i", "rows", "y", F.explode("x").alias("e")).select("i", "rows", "y", "e.j", "e.v"), "ridge-entries")
        j, v, rows = F.col("j"), F.col("v"), F.col("rows")
        zero = F.lit(0.0)
        # m: the diagonal, s: column sums, r: the residual, w: the weights, p: the direction
        state = kept(
            entries.groupBy("j").agg(
                (F.sum(rows * v * v) + self.alpha).alias("m"), F.sum(rows * v).alias("s"), F.sum(v * F.col("y")).alias("r"))
            .select("j", "m", "s", "r", zero.alias("w"), (F.col("r") / F.col("m")).alias("p")), "ridge-state")

        def size(df: DataFrame) -> float:
            return df.agg(F.sum(F.col("r") * F.col("r") / F.col("m"))).first()[0] or 0.0

        first = rho = size(state)
        for _ in range(self.max_iter):
            if rho <= self.tol ** 2 * first:
                break
            shift = state.agg(F.sum(F.col("s") * F.col("p"))).first()[0] / max(n, 1)
            along = entries.join(state.select("j", "p"), "j").groupBy("i").agg(F.sum(v * F.col("p")).alias("q"))
            back = entries.join(along, "i").groupBy("j").agg(F.sum(rows * v * F.col("q")).alias("a"))
            step = kept(
                state.join(back, "j").withColumn(
                    "a", F.col("a") + F.col("p") * self.alpha - F.col("s") * shift), "ridge-step")
            curvature = step.agg(F.sum(F.col("p") * F.col("a"))).first()[0]
            if not curvature > 0:
                break
            by = rho / curvature
            moved = step.select("j", "m", "s", "p", (F.col("r") - F.col("a") * by).alias("r"), (F.col("w") + F.col("p") * by).alias("w"))
            last, rho = rho, size(moved)
            state = moved.withColumn("p", F.col("r") / F.col("m") + F.col("p") * (rho / last))
        path = scratch_path(spark, "ridge-weights")
        state.select("j", "w").write.parquet(path)
        offset = state.agg(F.sum(F.col("s") * F.col("w"))).first()[0] or 0.0
        size_of = spark.read.parquet(path).count()
        for place in used:  # nothing reads them any more
            remove_path(spark, place)
        return WideRidgeModel({
            "features": self.features, "intercept": mean - offset / max(n, 1),
            "tables": {"weights": {"path": path, "size": size_of}}})
