"""Drift of every closed window of a stream against a reference that is summarised once.

The stream keeps one counter per window, column and value. When the watermark closes a window its counters
come out together, in one micro-batch, and are compared with the written reference profile: numeric columns
by the two-sample Kolmogorov-Smirnov statistic, others by chi-square. Both are exact. The reference itself is
not read again, only its distinct values with their counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import c, to_double
from ..functions.significance import chi2_p, kolmogorov_p
from ..operators.drift import (
    SCORE_SCHEMA,
    THRESHOLD_KS,
    THRESHOLD_PVAL,
    WARNING_SHARE,
    ColumnSummary,
    DriftReport,
    drift_status,
    summarise_columns,
)
from ..session import let_workers_import, local_frame

WINDOW_KEY = ["window_start", "window_end"]
SCORES = ("window_start timestamp, window_end timestamp, column string, method string, statistic double, p_value double, "
          "n_new bigint, drifted boolean")
_COLUMNS = "i int, name string, numeric boolean, n_ref bigint, bounds array<double>"


@dataclass(frozen=True)
class ReferenceProfile:
    """A written summary of the reference: its columns, value counts and categories under *path*."""

    path: str
    columns: list[ColumnSummary]

    def values(self, spark: SparkSession) -> DataFrame:
        """(i, b, v, r, le): each distinct number of column i in range b, its rows, and the rows up to it."""
        return spark.read.parquet(f"{self.path}/values")

    def categories(self, spark: SparkSession) -> DataFrame:
        """(i, text, r): rows of each category."""
        return spark.read.parquet(f"{self.path}/categories")

    def compare(self, new: DataFrame) -> DriftReport:
        """Drift of a whole frame, as ``detect_drift`` gives it."""
        spark = new.sparkSession
        cells = _cells(new, self.columns).groupBy("i", "num", "text").agg(F.count(F.lit(1)).alias("n"))
        always = F.lit(0).cast("timestamp")
        cells = cells.withColumns(dict.fromkeys(WINDOW_KEY, always)).persist()
        try:
            rows = drift_of_windows(self, cells).collect()
        finally:
            cells.unpersist()
        place = {x.name: i for i, x in enumerate(self.columns)}
        rows.sort(key=lambda r: place[r["column"]])
        drifted = [r["column"] for r in rows if r.drifted]
        scores = [(r["column"], r["method"], r.statistic, r.p_value, r.drifted) for r in rows]
        return DriftReport(
            local_frame(spark, scores, SCORE_SCHEMA), drift_status(len(drifted), len(self.columns)), drifted,
            len(self.columns), len(scores))


def _cells(df: DataFrame, columns: list[ColumnSummary], *keep: Column) -> DataFrame:
    """One row per value: i, num or text; values that are NULL (or NaN) are left out by the callers' joins."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for i, x in enumerate(columns):
        number = to_double(c(x.name), types[x.name]) if x.numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if x.numeric else c(x.name).cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), number.alias("num"), text.alias("text")))
    return df.select(*keep, F.explode(F.array(*cells)).alias("x")).select(
        *[k for k in df.select(*keep).columns], "x.i", "x.num", "x.text")


def _ranged(values: DataFrame, columns: list[ColumnSummary], number: str) -> DataFrame:
    """Adds the range b of each number; ranges depend on the value alone."""
    out = values.withColumn("b", F.lit(0))
    for i, x in enumerate(columns):
        if x.bounds:
            own = Bucketizer(inputCol=number, outputCol="_b", splits=[-math.inf, *x.bounds, math.inf], handleInvalid="keep")
            out = own.transform(out).withColumn("b", F.when(F.col("i") == i, F.col("_b").cast("int")).otherwise(F.col("b"))).drop("_b")
    return out


def reference_profile(reference: DataFrame, path: str, cols: list[str] | None = None) -> ReferenceProfile:
    """Count the reference once, per column and distinct value, and write the counts under *path*."""
    spark = reference.sparkSession
    columns = summarise_columns(reference, cols)
    counted = _cells(reference, columns).groupBy("i", "num", "text").agg(F.count(F.lit(1)).alias("r"))
    counted.filter("text is not null").select("i", "text", "r").write.parquet(f"{path}/categories")
    values = _ranged(counted.filter("num is not null").select("i", F.col("num").alias("v"), "r"), columns, "v")
    inside = Window.partitionBy("i", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    lower = Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    below = values.groupBy("i", "b").agg(F.sum("r").alias("n")).select(
        "i", "b", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))
    values.withColumn("inside", F.sum("r").over(inside)).join(below, ["i", "b"]).select(
        "i", "b", "v", "r", (F.col("inside") + F.col("below")).alias("le")).write.parquet(f"{path}/values")
    rows = [(i, x.name, x.numeric, x.n_ref, list(x.bounds)) for i, x in enumerate(columns)]
    local_frame(spark, rows, _COLUMNS).coalesce(1).write.parquet(f"{path}/columns")  # last: marks the profile complete
    return ReferenceProfile(path, columns)


def load_profile(spark: SparkSession, path: str) -> ReferenceProfile:
    rows = spark.read.schema(_COLUMNS).parquet(f"{path}/columns").orderBy("i").collect()
    return ReferenceProfile(path, [ColumnSummary(r["name"], r["numeric"], r.n_ref, 0, tuple(r.bounds)) for r in rows])


def window_cells(
    stream: DataFrame, profile: ReferenceProfile, time_col: str, window: str = "1 day", slide: str | None = None,
    watermark: str = "1 day",
) -> DataFrame:
    """(window_start, window_end, i, num, text, n): the state of the stream, one counter per value and window."""
    if isinstance(stream.schema[time_col].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time_col, c(time_col).cast("timestamp"))
    frame = F.window("_time", window, slide) if slide else F.window("_time", window)
    marked = stream.withWatermark(time_col, watermark)
    cells = _cells(marked, profile.columns, c(time_col).alias("_time"))
    return cells.groupBy(frame.alias("w"), "i", "num", "text").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "i", "num", "text", "n")


def _ks(spark: SparkSession, profile: ReferenceProfile, cells: DataFrame, totals: DataFrame) -> DataFrame:
    """(window, i, statistic): the largest gap between the two distribution functions.

    Between two values of a window its own function is flat and the reference's rises, so the gap is largest
    at a value of the window or just before one; both need the reference's counts there only.
    """
    own = _ranged(cells.filter("num is not null").withColumnRenamed("num", "v"), profile.columns, "v")
    inside = Window.partitionBy(*WINDOW_KEY, "i", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    lower = Window.partitionBy(*WINDOW_KEY, "i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy(*WINDOW_KEY, "i", "b").agg(F.sum("n").alias("m")).select(
        *WINDOW_KEY, "i", "b", F.coalesce(F.sum("m").over(lower), F.lit(0)).alias("before"))
    running = own.withColumn("cum", F.sum("n").over(inside)).join(before, [*WINDOW_KEY, "i", "b"]).select(
        *WINDOW_KEY, "i", "b", "v", "n", (F.col("cum") + F.col("before")).alias("cum"))
    # the reference's counts at each value that occurs in a window, range by range
    reference = profile.values(spark)
    known = reference.select("i", "b", "v", "r", "le").unionByName(
        own.select("i", "b", "v").distinct(), allowMissingColumns=True)
    # rows of all lower ranges of the reference, for values below the first one of their range
    base = [(i, b, n) for i, x in enumerate(profile.columns) if x.numeric for b, n in _below(reference, i, x)]
    upto = Window.partitionBy("i", "b").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy("i", "b", "v")
    looked_up = (
        known.withColumn("le", F.max("le").over(upto)).withColumn("r", F.coalesce(F.max("r").over(at), F.lit(0)))
        .groupBy("i", "b", "v").agg(F.max("le").alias("le"), F.max("r").alias("r"))
        .join(local_frame(spark, base, "i int, b int, base bigint"), ["i", "b"])
        .select("i", "b", "v", F.coalesce("le", "base").alias("le"), "r"))
    share = F.col("cum") / F.col("n_new"), (F.col("cum") - F.col("n")) / F.col("n_new")
    gap = F.greatest(F.abs(F.col("le") / F.col("n_ref") - share[0]), F.abs((F.col("le") - F.col("r")) / F.col("n_ref") - share[1]))
    return running.join(looked_up, ["i", "b", "v"]).join(totals, [*WINDOW_KEY, "i"]).groupBy(*WINDOW_KEY, "i").agg(
        F.max(gap).alias("statistic"))


def _below(reference: DataFrame, i: int, x: ColumnSummary) -> list[tuple[int, int]]:
    """Per range of a column, the reference rows in lower ranges; one number per range."""
    sizes = {}
    if x.bounds:
        sizes = {r.b: r.n for r in reference.filter(F.col("i") == i).groupBy("b").agg(F.sum("r").alias("n")).collect()}
    out, total = [], 0
    for b in range(len(x.bounds) + 1):
        out.append((b, total))
        total += sizes.get(b, 0)
    return out


def _chi2(spark: SparkSession, profile: ReferenceProfile, cells: DataFrame, totals: DataFrame) -> DataFrame:
    """(window, i, statistic, k) with the continuity correction when there are two categories.

    A category that a window lacks adds its reference rows times n_new / n_ref, so those need no row of their own.
    """
    known = profile.categories(spark)
    kinds = known.groupBy("i").agg(F.count(F.lit(1)).alias("k_ref"))
    rows = cells.filter("text is not null").join(known, ["i", "text"], "left").join(totals, [*WINDOW_KEY, "i"])
    r, n, whole = F.coalesce("r", F.lit(0)), F.col("n"), F.col("n_ref") + F.col("n_new")

    def terms(observed: Column, both: Column, total: str, corrected: bool) -> Column:
        expected = both * F.col(total) / whole
        off = F.abs(observed - expected)
        off = off - F.least(F.lit(0.5), off) if corrected else off
        return off * off / expected

    def cell(corrected: bool) -> Column:
        return terms(r, r + n, "n_ref", corrected) + terms(n, r + n, "n_new", corrected)

    sums = rows.groupBy(*WINDOW_KEY, "i", "n_ref", "n_new").agg(
        F.sum(cell(False)).alias("plain"), F.sum(cell(True)).alias("yates"), F.sum(r).alias("seen"),
        F.count_if(F.col("r").isNull()).alias("fresh"), F.count("r").alias("common")).join(kinds, "i")
    missing = F.col("n_ref") - F.col("seen")
    k = F.col("k_ref") + F.col("fresh")
    lone = F.when(F.col("k_ref") > F.col("common"), terms(missing, missing, "n_ref", True)
                  + terms(F.lit(0), missing, "n_new", True)).otherwise(0.0)
    plain = F.col("plain") + missing * F.col("n_new") / F.col("n_ref")
    return sums.select(*WINDOW_KEY, "i", k.alias("k"), F.when(k == 2, F.col("yates") + lone).otherwise(plain).alias("statistic"))


@F.pandas_udf(T.DoubleType())
def _p_value(statistic: pd.Series, k: pd.Series, n_ref: pd.Series, n_new: pd.Series) -> pd.Series:
    return pd.Series([
        kolmogorov_p(s, int(a), int(b)) if pd.isna(kinds) else chi2_p(s, int(kinds) - 1)
        for s, kinds, a, b in zip(statistic, k, n_ref, n_new)], dtype="float64")


def drift_of_windows(
    profile: ReferenceProfile, cells: DataFrame, threshold_ks: float = THRESHOLD_KS, threshold_pval: float = THRESHOLD_PVAL,
) -> DataFrame:
    """One row per window and column that has values on both sides: statistic, p_value, n_new, drifted.

    Columns of one category in all are skipped.
    """
    spark = cells.sparkSession
    let_workers_import(spark)
    names = local_frame(
        spark, [(i, x.name, x.numeric, x.n_ref) for i, x in enumerate(profile.columns) if x.n_ref],
        "i int, column string, numeric boolean, n_ref bigint")
    sizes = cells.filter("num is not null or text is not null").groupBy(*WINDOW_KEY, "i").agg(F.sum("n").alias("n_new"))
    totals = sizes.join(names, "i")
    none = F.lit(None).cast("bigint").alias("k")
    scores = _ks(spark, profile, cells, totals).select(*WINDOW_KEY, "i", none, "statistic").unionByName(
        _chi2(spark, profile, cells, totals)).filter("k is null or k > 1")
    p = F.col("p_value")
    return scores.join(totals, [*WINDOW_KEY, "i"]).withColumn(
        "p_value", _p_value("statistic", "k", "n_ref", "n_new")).select(
        *WINDOW_KEY, "column", F.when(F.col("numeric"), "kolmogorov-smirnov").otherwise("chi-square").alias("method"),
        "statistic", "p_value", "n_new",
        F.when(F.col("numeric"), F.col("statistic") > threshold_ks).otherwise(p < threshold_pval).alias("drifted"))


def window_status(scores: DataFrame, n_compared: int) -> DataFrame:
    """Per window: ok without drift, warning up to 30 % of the compared columns, else alert."""
    share = F.col("n_drifted") / n_compared
    return scores.groupBy(*WINDOW_KEY).agg(F.count_if("drifted").alias("n_drifted")).select(
        *WINDOW_KEY, "n_drifted", F.when(share == 0, "ok").when(share <= WARNING_SHARE, "warning").otherwise("alert").alias("status"))


def watch_windows(
    cells: DataFrame, profile: ReferenceProfile, path: str, checkpoint: str,
    trigger: dict | None = None, then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write the drift of each window under *path* when it closes.

    *path* and *checkpoint* belong to the caller: a query started again with both goes on where it stopped, and
    a micro-batch that is repeated replaces its own folder, so each window appears once. *then* gets every
    micro-batch's scores.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            target = f"{path}/batch={batch_id}"
            # most micro-batches close no window
            scores = local_frame(batch.sparkSession, [], SCORES) if batch.isEmpty() else drift_of_windows(profile, batch)
            scores.write.mode("overwrite").parquet(target)
            if then is not None:
                then(batch.sparkSession.read.parquet(target), batch_id)
        finally:
            batch.unpersist()

    return (
        cells.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).option("recursiveFileLookup", "true").parquet(path)
