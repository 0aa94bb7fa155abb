"""Null tokens, numeric parsing and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts read as missing in a CSV field.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A decimal number, or a spelled-out infinity / NaN; Spark's own cast would
# also take type suffixes such as "1d".
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def null_tokens_to_null(col: Column) -> Column:
    return F.when(~col.isin(NULL_TOKENS), col)


def parse_number(col: Column) -> Column:
    """Text to double; NULL where it is not a number (NaN counts as missing)."""
    text = F.trim(col)
    value = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def relative_age(seconds: Column) -> Column:
    """``42s ago`` / ``5m ago`` / ``3h ago`` / ``2d ago``."""
    def label(divisor: int, unit: str) -> Column:
        return F.concat(F.floor(seconds / divisor).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds < 60, label(1, "s"))
        .when(seconds < 3600, label(60, "m"))
        .when(seconds < 86400, label(3600, "h"))
        .otherwise(label(86400, "d"))
    )


def metric_band(value: Column) -> Column:
    """Display band of a score: the magnitude, at most 1, below .5 / below .75 / above."""
    size = F.least(F.abs(value), F.lit(1.0))
    return F.when(size < 0.5, "red").when(size < 0.75, "amber").otherwise("normal")
