"""Dataset cleaning and profiling: duplicates, text that holds numbers, nulls."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, categorical_columns, numeric_columns, replace_columns, to_double
from ..functions.quantiles import exact_quantiles
from ..functions.stats import frequencies, moments
from ..functions.text import parse_number
from ..session import scratch_path
from .fill import fill_nulls

# The null strategies.
FILL_STRATEGIES = ("mean", "median", "mode", "drop")


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; nulls compare equal. Combined map-side, so hot rows collapse early."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows :func:`dedupe_rows` would remove, as one aggregate."""
    groups = df.groupBy(*[c(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column: one row, one column per input column."""
    return df.agg(*[F.count_if(c(n).isNull()).alias(n) for n in df.columns])


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def number_columns(df: DataFrame, min_fraction: float = 0.0) -> list[str]:
    """Text columns with at least one number; all of them are tested in one aggregate.

    *min_fraction* (of the non-null values) asks for more than one number.
    """
    cols = categorical_columns(df.schema)
    if not cols:
        return []
    aggs = []
    for i, name in enumerate(cols):
        aggs += [F.count(parse_number(c(name))).alias(f"num{i}"), F.count(c(name)).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    return [
        name for i, name in enumerate(cols)
        if row[f"num{i}"] > 0 and row[f"num{i}"] >= min_fraction * row[f"n{i}"]
    ]


def to_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return replace_columns(df, {name: parse_number(c(name)) for name in cols})


def fix_dtypes(df: DataFrame, min_fraction: float = 0.0) -> DataFrame:
    """Text columns that hold a number become double; what is no number becomes null."""
    return to_numbers(df, number_columns(df, min_fraction))


def fill_values(df: DataFrame, strategy: str) -> dict[str, Any]:
    """The constants that *strategy* fills with, one job for all columns."""
    if strategy == "mean":
        return {n: m.mean for n, m in moments(df, numeric_columns(df.schema)).items()}
    if strategy == "median":
        found = exact_quantiles(df, numeric_columns(df.schema), [0.5])
        return {n: v[0] for n, v in found.items()}
    if strategy == "mode":
        return {n: f.mode for n, f in frequencies(df, dict.fromkeys(df.columns, 1)).items()}
    raise ValueError(f"fill_nulls must be one of {sorted(FILL_STRATEGIES)}, not '{strategy}'")


class Cleaner:
    """``{fill_nulls, drop_duplicates, fix_dtypes}`` applied in the order
    duplicates, types, nulls.

    mean / median fill numeric columns only; mode fills every column; drop
    removes each row that has any null.
    """

    def __init__(self, config: dict[str, Any] | None = None) -> None:
        config = config or {}
        self.strategy = config.get("fill_nulls", "mean")
        self.drop_duplicates = bool(config.get("drop_duplicates", True))
        self.fix_dtypes = bool(config.get("fix_dtypes", True))
        self.min_fraction = float(config.get("min_fraction", 0.0))
        if self.strategy not in FILL_STRATEGIES:
            raise ValueError(f"fill_nulls must be one of {sorted(FILL_STRATEGIES)}, not '{self.strategy}'")

    def clean(self, df: DataFrame) -> DataFrame:
        numbers: list[str] | None = None
        if self.fix_dtypes and self.min_fraction == 0.0:
            # whether a column holds any number does not depend on duplicates,
            # so the raw rows are asked, without shuffling them
            numbers = number_columns(df)
        if self.drop_duplicates:
            df = dedupe_rows(df)
            if self.strategy != "drop" or (self.fix_dtypes and numbers is None):
                df = self._settle(df)
        if self.fix_dtypes:
            df = to_numbers(df, numbers if numbers is not None else number_columns(df, self.min_fraction))
        if self.strategy == "drop":
            return drop_null_rows(df)
        return fill_nulls(df, fill_values(df, self.strategy), double=self.strategy != "mode")

    @staticmethod
    def _settle(df: DataFrame) -> DataFrame:
        """Write the distinct rows once: the fill statistics and the result both read
        them, and would otherwise each shuffle the whole table again."""
        path = scratch_path(df.sparkSession, "distinct")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-null value of one column."""
    return df.filter(c(col).isNotNull()).groupBy(c(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, nulls, mean, sample std, min, quartiles and max per numeric column."""
    names = cols if cols is not None else numeric_columns(df.schema)
    types = {f.name: f.dataType for f in df.schema.fields}
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    cells = []
    for name in names:
        v = to_double(c(name), types[name])
        q1, q2, q3 = quartiles[name]
        cells.append(F.struct(
            F.lit(name).alias("column"),
            F.count(v).alias("count"),
            F.count_if(v.isNull()).alias("nulls"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.lit(q1).cast("double").alias("q25"),
            F.lit(q2).cast("double").alias("q50"),
            F.lit(q3).cast("double").alias("q75"),
            F.max(v).alias("max"),
        ))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")
