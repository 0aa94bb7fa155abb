"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def c(name: str) -> Column:
    """The column of exactly that name (dots and the like are taken literally)."""
    return F.col(quoted(name))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: what follows does not recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package as the driver does; clusters ship it themselves."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """At most *rows* rows of text in one Arrow batch, unless the session asks for fewer.

    A batch is held by the JVM outside its heap and again by the worker, for every running task, and texts may be long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def _give_back() -> None:
    """Return what Arrow holds for later: a worker outlives its task and would keep the most that any batch took."""
    pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, rows: int = 512,
) -> DataFrame:
    """Apply *fn* to slices of at most *rows* rows; it returns the output columns as lists or arrays."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    _importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                columns = [
                    v if isinstance(v, pa.Array) and v.type == f.type else
                    v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type)
                    for f, v in ((f, out[f.name]) for f in kind)]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)
            out = columns = batch = None
            _give_back()

    return df.mapInArrow(run, schema)


def fold_partitions(
    df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], dict[str, list] | None], schema: str,
) -> DataFrame:
    """One small result per partition: *fold* reads its batches one by one and returns columns, or None for no row."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    _importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fold(b for b in batches if b.num_rows)
        _give_back()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], names=kind.names)

    return df.mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length without NULLs as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def finite(array: Column) -> Column:
    """True for arrays that are there and hold finite numbers only."""
    return array.isNotNull() & F.forall(array, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's text modulo *parts* is *part* (a NULL id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most *rows* rows in the order of a hash of *key*: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(c(key).cast("string")), c(key)).limit(rows)
