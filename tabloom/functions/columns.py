"""Schema helpers: type predicates, column-set resolution, name checks."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL_NUMERIC = "all_numeric"
ALL_CATEGORICAL = "all_categorical"


def q(name: str) -> str:
    """Quote a column name so that dots, ``^`` and ``*`` in it stay literal."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dtype: T.DataType) -> bool:
    """Integers, floats and decimals; booleans are not numeric."""
    return isinstance(dtype, T.NumericType)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(schema: T.StructType, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in schema.fields if is_numeric(f.dataType) and f.name not in skip]


def categorical_columns(schema: T.StructType, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in schema.fields if is_categorical(f.dataType) and f.name not in skip]


def resolve_columns(
    schema: T.StructType,
    cols: str | Sequence[str],
    exclude: Iterable[str] = (),
    warn_missing: str | None = None,
) -> list[str]:
    """Turn a sentinel or a list into the existing column names.

    ``"all_numeric"`` and ``"all_categorical"`` walk the schema and leave out
    *exclude* (target and key columns); a list keeps its order and drops names
    that do not exist. With *warn_missing* (a step name) a warning lists them.
    """
    if isinstance(cols, str):
        if cols == ALL_NUMERIC:
            return numeric_columns(schema, exclude)
        if cols == ALL_CATEGORICAL:
            return categorical_columns(schema, exclude)
        raise ValueError(f"cols must be a list, '{ALL_NUMERIC}' or '{ALL_CATEGORICAL}', not '{cols}'")
    names = set(schema.names)
    missing = [name for name in cols if name not in names]
    if missing and warn_missing:
        warnings.warn(f"{warn_missing}: columns not found and skipped: {missing}", UserWarning, stacklevel=3)
    return [name for name in cols if name in names]


def check_unique_names(names: Iterable[str]) -> None:
    """Reject names that differ only by case, which Spark cannot tell apart."""
    seen: dict[str, str] = {}
    for name in names:
        other = seen.setdefault(name.lower(), name)
        if other is not name:
            raise ValueError(f"column names '{other}' and '{name}' are the same when case is ignored")


def require_columns(df: DataFrame, names: Iterable[str], what: str = "Column") -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(f"{what} '{name}' is not among {df.columns}")


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that replaces columns in place, keeping their order."""
    return df.select(*[new[n].alias(n) if n in new else c(n) for n in df.columns])


def to_double(col: Column, dtype: T.DataType) -> Column:
    """Numeric or boolean column as double."""
    if isinstance(dtype, T.DoubleType):
        return col
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    return col.cast("double")
