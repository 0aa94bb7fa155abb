"""Distribution drift between a reference frame and a new frame.

Numeric columns get the two-sample Kolmogorov-Smirnov statistic, all others the
chi-square test of homogeneity. Columns are unpivoted, so each family is one
job however many columns there are, and rows are counted per distinct value
with map-side combining before anything is ordered.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, is_numeric, to_double
from ..functions.quantiles import sketch_grids
from ..functions.significance import chi2_p, kolmogorov_p
from ..session import local_frame

# Column names never compared, thresholds and status limits.
IGNORED_COLUMNS = ("id", "target")
THRESHOLD_KS = 0.1
THRESHOLD_PVAL = 0.05
WARNING_SHARE = 0.30

# One ordered range of values holds about this many rows; a sketch yields this many ranges at most,
# and ranges that are still too large are sketched again on their own.
RANGE_ROWS = 4_000_000
GRID_RANGES = 1000
RANGE_SKETCH = 2048

SCORE_SCHEMA = "column string, method string, statistic double, p_value double, drifted boolean"


@dataclass(frozen=True)
class ColumnSummary:
    """A compared column: its kind, values on either side, and the bounds of its value ranges."""

    name: str
    numeric: bool
    n_ref: int = 0
    n_new: int = 0
    bounds: tuple[float, ...] = ()


def common_columns(ref: DataFrame, new: DataFrame, ignore: Iterable[str] = IGNORED_COLUMNS) -> list[str]:
    """Columns of both frames, in the order of *new*, without id and target."""
    skip = {n.lower() for n in ignore}
    known = set(ref.columns)
    return [n for n in new.columns if n in known and n.lower() not in skip]


def _countable(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or isinstance(dtype, T.BooleanType)


def _stack(ref: DataFrame, new: DataFrame, columns: list[ColumnSummary]) -> DataFrame:
    """Both frames under each other: one value column per compared column, and is_new."""
    def side(df: DataFrame, is_new: bool) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        values = [
            (to_double(c(x.name), types[x.name]) if x.numeric else c(x.name).cast("string")).alias(f"v{i}")
            for i, x in enumerate(columns)
        ]
        return df.select(*values, F.lit(is_new).alias("is_new"))

    return side(ref, False).unionAll(side(new, True))


def _prepare(ref: DataFrame, new: DataFrame, names: list[str] | None) -> tuple[list[ColumnSummary], DataFrame]:
    """Column kinds, non-null counts and value ranges: one shuffle-free aggregate."""
    names = common_columns(ref, new) if names is None else list(names)
    columns = [
        ColumnSummary(n, _countable(ref.schema[n].dataType) and _countable(new.schema[n].dataType)) for n in names
    ]
    stacked = _stack(ref, new, columns)
    if not columns:
        return columns, stacked
    numeric = [i for i, x in enumerate(columns) if x.numeric]
    present = []
    for i in range(len(columns)):
        has = F.col(f"v{i}").isNotNull()
        present += [(has & ~F.col("is_new")).cast("bigint").alias(f"ref{i}"),
                    (has & F.col("is_new")).cast("bigint").alias(f"new{i}")]
    # ranges only balance the work, so an approximate grid is all they need
    row = sketch_grids(stacked, [F.col(f"v{i}") for i in numeric], GRID_RANGES, RANGE_SKETCH, present)
    grids = {i: (row[f"n{k}"], row[f"g{k}"]) for k, i in enumerate(numeric)}
    bounds = _split_ranges(stacked, {i: g for i, g in grids.items() if row[f"ref{i}"] and row[f"new{i}"]})
    return [
        ColumnSummary(x.name, x.numeric, row[f"ref{i}"], row[f"new{i}"], bounds.get(i, ()))
        for i, x in enumerate(columns)], stacked


def summarise_columns(ref: DataFrame, cols: list[str] | None = None) -> list[ColumnSummary]:
    """Kinds, non-null counts and value ranges of one frame alone (its rows count as the reference)."""
    ignored = [n for n in ref.columns if n.lower() not in {x.lower() for x in IGNORED_COLUMNS}]
    columns = [ColumnSummary(n, _countable(ref.schema[n].dataType)) for n in (ignored if cols is None else cols)]
    stacked = _stack(ref, ref.limit(0), columns)
    numeric = [i for i, x in enumerate(columns) if x.numeric]
    present = [F.col(f"v{i}").isNotNull().cast("bigint").alias(f"ref{i}") for i in range(len(columns))]
    row = sketch_grids(stacked, [F.col(f"v{i}") for i in numeric], GRID_RANGES, RANGE_SKETCH, present)
    bounds = _split_ranges(stacked, {i: (row[f"n{k}"], row[f"g{k}"]) for k, i in enumerate(numeric) if row[f"ref{i}"]})
    return [ColumnSummary(x.name, x.numeric, row[f"ref{i}"], 0, bounds.get(i, ())) for i, x in enumerate(columns)]


def _picked(grid: Sequence[float], rows: int) -> set[float]:
    """Bounds between ranges of about RANGE_ROWS rows, as many as the grid can tell apart."""
    ranges = min(math.ceil(rows / RANGE_ROWS), GRID_RANGES)
    return {grid[math.ceil(k * GRID_RANGES / ranges)] for k in range(1, ranges)}


def _split_ranges(stacked: DataFrame, grids: dict[int, tuple[int, Sequence[float]]]) -> dict[int, tuple[float, ...]]:
    """Bounds per column so that a range holds about RANGE_ROWS rows, however many ranges that takes.

    Ranges that hold twice as many are sketched again, all of a column in one job with a row per range, until
    none is left or its rows are one value. Only the bounds reach the driver: one number per RANGE_ROWS rows.
    """
    out = {i: tuple(sorted(_picked(grid, n))) for i, (n, grid) in grids.items()}
    todo = {i for i, (n, _) in grids.items() if n > GRID_RANGES * RANGE_ROWS}
    ranks = F.from_json(F.lit(json.dumps([k / GRID_RANGES for k in range(GRID_RANGES + 1)])), "array<double>")
    while todo:
        again = set()
        for i in todo:
            spread = Bucketizer(
                inputCol="v", outputCol="b", splits=[-math.inf, *out[i], math.inf], handleInvalid="keep",
            ).transform(stacked.select(F.col(f"v{i}").alias("v")).filter("v is not null"))
            crowded = spread.groupBy("b").agg(
                F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                F.kll_sketch_agg_double("v", RANGE_SKETCH).alias("s"),
            ).filter((F.col("n") > 2 * RANGE_ROWS) & (F.col("lo") < F.col("hi")))
            found = crowded.select("n", "lo", "hi", F.kll_sketch_get_quantile_double("s", ranks).alias("grid")).collect()
            fresh = set()
            for r in found:
                fresh |= _picked([r.lo, *r.grid[1:-1], r.hi], r.n)
                # where nearly all rows are one value, that value becomes a range of its own
                fresh |= {r.grid[GRID_RANGES // 2], math.nextafter(r.grid[GRID_RANGES // 2], math.inf)}
            fresh -= set(out[i])
            fresh = {v for v in fresh if math.isfinite(v)}
            if fresh:
                out[i] = tuple(sorted({*out[i], *fresh}))
                again.add(i)
        todo = again
    return out


def _of_column(values: list[float], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)


def _ks(stacked: DataFrame, columns: list[ColumnSummary]) -> DataFrame:
    """(i, statistic): largest gap between the two cumulative distributions.

    A column is cut into value ranges. Running counts are taken inside each
    range; the counts of all lower ranges are added from a table that has one
    row per range. Range membership depends on the value alone, so a retried
    task sees the same ranges.
    """
    tested = [i for i, x in enumerate(columns) if x.numeric and x.n_ref and x.n_new]
    ranged = [i for i in tested if columns[i].bounds]
    wide = stacked
    if ranged:
        wide = Bucketizer(
            inputCols=[f"v{i}" for i in ranged],
            outputCols=[f"b{i}" for i in ranged],
            splitsArray=[[-math.inf, *columns[i].bounds, math.inf] for i in ranged],
            handleInvalid="keep",
        ).transform(wide)
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            (F.col(f"b{i}").cast("int") if i in ranged else F.lit(0)).alias("b"),
            F.col(f"v{i}").alias("v"),
        )
        for i in tested
    ])
    long = wide.select("is_new", F.explode(cells).alias("x")).filter(F.col("x.v").isNotNull())
    counts = long.groupBy(F.col("x.i").alias("i"), F.col("x.b").alias("b"), F.col("x.v").alias("v")).agg(
        F.count_if(~F.col("is_new")).alias("r"), F.count_if(F.col("is_new")).alias("n"))
    inside = Window.partitionBy("i", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select("i", "b", F.sum("r").over(inside).alias("r"), F.sum("n").over(inside).alias("n"))
    if ranged:
        lower = Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.groupBy("i", "b").agg(F.sum("r").alias("r0"), F.sum("n").alias("n0")).select(
            "i", "b",
            F.coalesce(F.sum("r0").over(lower), F.lit(0)).alias("r0"),
            F.coalesce(F.sum("n0").over(lower), F.lit(0)).alias("n0"))
        running = running.join(offsets, ["i", "b"]).select(
            "i", (F.col("r") + F.col("r0")).alias("r"), (F.col("n") + F.col("n0")).alias("n"))
    total_ref = _of_column([float(x.n_ref) for x in columns], F.col("i"))
    total_new = _of_column([float(x.n_new) for x in columns], F.col("i"))
    gap = F.abs(F.col("r") / total_ref - F.col("n") / total_new)
    return running.groupBy("i").agg(F.max(gap).alias("statistic"))


def category_counts(stacked: DataFrame, columns: list[ColumnSummary], tested: list[int]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in tested])
    long = stacked.select("is_new", F.explode(cells).alias("x")).filter(F.col("x.v").isNotNull())
    return long.groupBy(F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(
        F.count_if(~F.col("is_new")).alias("r"), F.count_if(F.col("is_new")).alias("n"))


def _chi2(stacked: DataFrame, columns: list[ColumnSummary]) -> DataFrame:
    """(i, k, statistic) with the continuity correction when there are two categories."""
    tested = [i for i, x in enumerate(columns) if not x.numeric and x.n_ref and x.n_new]
    counts = category_counts(stacked, columns, tested)
    total_ref = _of_column([float(x.n_ref) for x in columns], F.col("i"))
    total_new = _of_column([float(x.n_new) for x in columns], F.col("i"))
    both = F.col("r") + F.col("n")

    def cell(observed: str, total: Column, corrected: bool) -> Column:
        expected = both * total / (total_ref + total_new)
        off = F.abs(F.col(observed) - expected)
        if corrected:
            off = off - F.least(F.lit(0.5), off)
        return off * off / expected

    def statistic(corrected: bool) -> Column:
        return F.sum(cell("r", total_ref, corrected) + cell("n", total_new, corrected))

    sums = counts.groupBy("i").agg(
        F.count(F.lit(1)).alias("k"), statistic(False).alias("plain"), statistic(True).alias("yates"))
    return sums.select("i", "k", F.when(F.col("k") == 2, F.col("yates")).otherwise(F.col("plain")).alias("statistic"))


def category_alignment(ref: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """Rows per category in either frame; a category missing on one side counts 0."""
    columns = [ColumnSummary(col, False)]
    counts = category_counts(_stack(ref, new, columns), columns, [0])
    return counts.select(F.col("v").alias("category"), F.col("r").alias("n_ref"), F.col("n").alias("n_new"))


def ks_statistics(ref: DataFrame, new: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, statistic, n_ref, n_new) for the numeric columns that have values on both sides."""
    columns, stacked = _prepare(ref, new, cols)
    return _named(ref, columns, _ks(stacked, columns))


def chi2_statistics(ref: DataFrame, new: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, k, statistic, n_ref, n_new) for the categorical columns with values on both sides."""
    columns, stacked = _prepare(ref, new, cols)
    return _named(ref, columns, _chi2(stacked, columns))


def _named(ref: DataFrame, columns: list[ColumnSummary], result: DataFrame) -> DataFrame:
    names = local_frame(
        ref.sparkSession, [(i, x.name, x.n_ref, x.n_new) for i, x in enumerate(columns)],
        "i int, column string, n_ref bigint, n_new bigint")
    rest = [n for n in result.columns if n != "i"]
    return result.join(names, "i").select("column", *rest, "n_ref", "n_new")


@dataclass(frozen=True)
class DriftReport:
    """One row per tested column, and the verdict over all compared columns."""

    scores: DataFrame
    status: str
    features_drifted: list[str]
    n_compared: int
    n_tested: int

    def summary(self) -> DataFrame:
        return local_frame(
            self.scores.sparkSession,
            [(self.status, self.features_drifted, len(self.features_drifted), self.n_compared, self.n_tested)],
            "status string, features_drifted array<string>, n_drifted int, n_compared int, n_tested int")


def drift_status(n_drifted: int, n_compared: int) -> str:
    """ok without drift, warning up to 30 % of the compared columns, else alert."""
    share = n_drifted / n_compared if n_compared else 0.0
    if share == 0.0:
        return "ok"
    return "warning" if share <= WARNING_SHARE else "alert"


def detect_drift(
    ref: DataFrame,
    new: DataFrame,
    threshold_ks: float = THRESHOLD_KS,
    threshold_pval: float = THRESHOLD_PVAL,
    cols: list[str] | None = None,
) -> DriftReport:
    """Test every common column; columns without values, or of one category, are skipped.

    Skipped columns stay in the denominator of the status. Only one row per
    column reaches the driver, where the p-value is added.
    """
    columns, stacked = _prepare(ref, new, cols)
    scores: dict[int, tuple[str, str, float, float, bool]] = {}
    if any(x.numeric and x.n_ref and x.n_new for x in columns):
        for row in _ks(stacked, columns).collect():
            x, d = columns[row["i"]], row["statistic"]
            p = kolmogorov_p(d, x.n_ref, x.n_new)
            scores[row["i"]] = (x.name, "kolmogorov-smirnov", d, p, d > threshold_ks)
    if any(not x.numeric and x.n_ref and x.n_new for x in columns):
        for row in _chi2(stacked, columns).collect():
            if row["k"] > 1:
                x, stat = columns[row["i"]], row["statistic"]
                p = chi2_p(stat, row["k"] - 1)
                scores[row["i"]] = (x.name, "chi-square", stat, p, p < threshold_pval)
    rows = [scores[i] for i in sorted(scores)]
    drifted = [r[0] for r in rows if r[4]]
    return DriftReport(
        local_frame(ref.sparkSession, rows, SCORE_SCHEMA),
        drift_status(len(drifted), len(columns)), drifted, len(columns), len(rows))
