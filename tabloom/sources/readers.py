"""Load CSV, JSON and Parquet datasets with one notion of a missing value.

Whatever the format, empty tokens and NaN become NULL, so that every aggregate
downstream skips them.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, check_unique_names, replace_columns
from ..functions.text import nan_to_null, null_tokens_to_null, parse_number

INTEGER_PATTERN = r"^[+-]?\d+$"
BOOLEANS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN to NULL in float and double columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return replace_columns(df, {n: nan_to_null(c(n)) for n in floats}) if floats else df


# Rows looked at first: what they contradict needs no test over all rows.
PEEK_ROWS = 1000


def _tests(name: str) -> dict[str, Column]:
    """Per kind, what every value of a column of that kind must be."""
    text = F.trim(c(name))
    return {
        "bigint": text.try_cast("bigint").isNotNull() & text.rlike(INTEGER_PATTERN),
        "decimal(38,0)": text.try_cast("decimal(38,0)").isNotNull() & text.rlike(INTEGER_PATTERN),
        "double": parse_number(c(name)).isNotNull(),
        "boolean": text.isin(BOOLEANS),
    }


def _holding(df: DataFrame, kinds: dict[str, list[str]]) -> tuple[dict[str, list[str]], dict[str, int]]:
    """The kinds that every value of each column passes, and how many values there are; one aggregate."""
    aggs = [F.count(c(name)).alias(f"n{i}") for i, name in enumerate(kinds)]
    for i, (name, some) in enumerate(kinds.items()):
        tests = _tests(name)
        aggs += [F.count_if(tests[kind]).alias(f"{i}:{kind}") for kind in some]
    row = df.agg(*aggs).first()
    count = {name: row[f"n{i}"] for i, name in enumerate(kinds)}
    return {n: [k for k in some if row[f"{i}:{k}"] == count[n]] for i, (n, some) in enumerate(kinds.items())}, count


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns that hold only integers, numbers or booleans get that type.

    Whole numbers become bigint, if one of them does not fit decimal(38,0), and only
    beyond that double. A first few rows rule kinds out for good; the narrowest kind left is
    tested on all rows, and wider ones only for columns that fail it. Pass a schema to avoid that.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    left, _ = _holding(df.select(*[c(n) for n in cols]).limit(PEEK_ROWS), {n: list(_tests(n)) for n in cols})
    new = {}
    while left := {n: kinds for n, kinds in left.items() if kinds}:
        held, count = _holding(df, {n: kinds[:1] for n, kinds in left.items()})
        for name, kinds in left.items():
            if held[name] and count[name]:
                kind = kinds[0]
                new[name] = parse_number(c(name)) if kind == "double" else F.trim(c(name)).cast(kind)
        left = {n: kinds[1:] for n, kinds in left.items() if not held[n]}
    return replace_columns(df, new)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False, **options,
) -> DataFrame:
    """CSV with a header. Without a schema the types are found after the null tokens are gone.

    Fields may hold line breaks only with ``multiline=True``, since files can then not be
    split. A record with too many or too few fields fails the read (``mode="PERMISSIVE"``
    shifts or fills such rows as Spark does).
    """
    reader = spark.read.options(**{"escape": '"', "mode": "FAILFAST", "multiLine": multiline, **options})
    # Spark would silently rename clashing header names, so look at them first
    header = reader.option("mode", "PERMISSIVE").csv(path).limit(1).collect()
    check_unique_names(name for name in (header[0] if header else []) if name is not None)
    text = reader.option("mode", options.get("mode", "FAILFAST")).option("header", True).csv(path)
    text = replace_columns(text, {n: null_tokens_to_null(c(n)) for n in text.columns})
    if schema is None:
        return infer_types(text)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return text.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in kind.fields])


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool | None = None, **options,
) -> DataFrame:
    """JSON lines, or one array of records per file (``lines=False``; such a file is one task).

    If *lines* is not given, the first character decides.
    """
    if lines is None:
        # up to the first colon, which ends the first key: a line can be a whole file
        start = F.regexp_extract("value", r"\S", 0).alias("start")
        first = spark.read.option("lineSep", ":").text(path).select(start).filter("start <> ''").first()
        lines = first is None or first.start != "["
    reader = spark.read.options(multiLine=not lines, **options)
    return normalize_nulls((reader.schema(schema) if schema is not None else reader).json(path))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return normalize_nulls((reader.schema(schema) if schema is not None else reader).parquet(path))


READERS: dict[str, Callable[..., DataFrame]] = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet}


def register_reader(extension: str, reader: Callable[..., DataFrame]) -> None:
    """Add a format: ``reader(spark, path, schema, **options)``."""
    READERS[extension.lower()] = reader


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Load a dataset; the reader is chosen by the file extension."""
    ext = PurePosixPath(path.rstrip("/")).suffix.lower()
    try:
        if ext not in READERS:
            # a missing file is reported as such even when its format is unknown
            spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
            raise ValueError(f"there is no reader for '{ext}' files; known: {', '.join(READERS)}")
        df = READERS[ext](spark, path, schema, **options)
        check_unique_names(df.columns)
        return df
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"nothing to read at {path}") from error
        raise
