"""Encoding steps: one-hot indicators and integer labels.

One-hot gives one int column per category, however many there are, or with
``output="sparse"`` one vector column; nothing but that option decides. Labels
are the ranks of the categories' text. Up to ``max_categories`` of them are kept
in the model, more are written as a table and joined in; the codes are the same.
"""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, replace_columns
from ..functions.ranking import sorted_positions
from ..functions.stats import Frequencies, Moments, TrainingStats, json_value, literal
from ..session import local_frame, scratch_path
from .step import Step, StepModel

MAX_CATEGORIES = 1000
MAX_COLUMNS = 10_000  # of a dense one-hot
# Beyond this many categories a hash join is cheaper than scanning a list per row.
LIST_LOOKUP = 64


def indicator(col: Column, category: Any, dtype: T.DataType) -> Column:
    """1 where the column equals the category, else 0 (also for null)."""
    return col.eqNullSafe(literal(category, dtype)).cast("int")


def onehot(df: DataFrame, categories: dict[str, list[Any]]) -> DataFrame:
    """Replace each column by one int indicator per category, appended at the end."""
    types = {f.name: f.dataType for f in df.schema.fields}
    added = {
        f"{name}_{k}": indicator(c(name), k, types[name])
        for name, values in categories.items() if name in types for k in values
    }
    rest = [n for n in df.columns if n not in categories]
    clash = [n for n in added if n in rest]
    if clash:
        raise ValueError(f"one-hot column names already exist: {clash}")
    return df.select(*[c(n) for n in rest], *[v.alias(n) for n, v in added.items()])


def label_code(col: Column, categories: list[Any], dtype: T.DataType) -> Column:
    """Position of the value in the list, -1 when unseen or null."""
    if not categories:
        return F.lit(-1).cast("bigint")
    known = F.array(*[literal(k, dtype) for k in categories])
    return (F.coalesce(F.array_position(known, col), F.lit(0)) - 1).cast("bigint")


def label_join(df: DataFrame, key: Column, table: DataFrame, out: str, default: int = -1) -> DataFrame:
    """Codes from a ``(value, code)`` table; adaptive execution picks the join.

    A hot category only makes the streamed side skewed, which the adaptive
    skew-join rule splits; a small table is broadcast by its measured size.
    """
    codes = table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(codes, key == F.col("_value"), "left")
    code = F.coalesce(F.col("_code"), F.lit(default)).cast("bigint")
    if out in df.columns:
        return joined.select(*[code.alias(n) if n == out else c(n) for n in df.columns])
    return joined.select(*[c(n) for n in df.columns], code.alias(out))


def category_table(df: DataFrame, col: str) -> str:
    """Write ``(value, code)`` for all categories of a column, as text; returns the path."""
    path = scratch_path(df.sparkSession, "categories")
    sorted_positions(df.select(c(col).cast("string").alias("value")), "value", "code", path)
    return path


def list_table(df: DataFrame, categories: list[Any], dtype: T.DataType) -> DataFrame:
    """A fitted category list as a local ``(value, code)`` relation."""
    kind = dtype if isinstance(dtype, (T.StringType, T.NumericType, T.BooleanType)) else T.StringType()
    kind = T.StringType() if isinstance(kind, T.DecimalType) else kind
    schema = T.StructType([T.StructField("value", kind), T.StructField("code", T.LongType())])
    table = local_frame(df.sparkSession, [(k, i) for i, k in enumerate(categories)], schema)
    return table.withColumn("value", F.col("value").cast(dtype))


def one_slot(code: Column, size: int) -> Column:
    """A sparse vector of *size* slots with a one at *code*, all zeros beyond.

    Read from its JSON form: the encoder of Spark ML names every slot in the schema, which is as long as the categories.
    """
    kind = T.StructType([T.StructField("v", VectorUDT())])
    inside = code < size
    slot, value = F.when(inside, code.cast("string")).otherwise(""), F.when(inside, "1.0").otherwise("")
    text = F.concat(F.lit(f'{{"v":{{"type":0,"size":{size},"indices":['), slot, F.lit('],"values":['), value, F.lit("]}}"))
    return F.from_json(text, kind)["v"]


class OneHotModel(StepModel):
    """State: ``categories`` (dense columns) and ``tables`` (sparse vectors)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = onehot(dataset, self.fitted["categories"])
        for name, info in self.fitted["tables"].items():
            if name not in dataset.columns:
                continue
            size, code, vector = info["size"], f"{name}_code", f"{name}_vec"
            table = dataset.sparkSession.read.parquet(info["path"])
            # the last slot, dropped by the encoder, stands for unseen and null
            coded = label_join(out, c(name).cast("string"), table, code, default=size)
            if vector in coded.columns:
                raise ValueError(f"output column {vector} already exists")
            others = [n for n in coded.columns if n not in (code, name)]
            out = coded.select(*[c(n) for n in others], one_slot(F.col(code), size).alias(
                vector, metadata={"ml_attr": {"num_attrs": size}}))
        return out

    def carry(self, stats: TrainingStats, schema: T.StructType) -> None:
        types = {f.name: f.dataType for f in schema.fields}
        for name, values in self.fitted["categories"].items():
            known = stats.frequencies.get(name)
            if known is None or not known.complete or name not in types:
                continue
            rows = known.nulls + sum(n for _, n in known.values)
            if rows == 0:
                continue
            counts = {json_value(v): n for v, n in known.values}
            for k in values:
                n = counts.get(k, 0)
                stats.moments[f"{name}_{k}"] = Moments.of_counts([(0.0, rows - n), (1.0, n)])


class LabelEncodeModel(StepModel):
    """State: ``categories`` (short lists, in code order) and ``tables``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        short, long = {}, {}
        for name, values in self.fitted["categories"].items():
            if name in dataset.columns:
                (short if len(values) <= LIST_LOOKUP else long)[name] = values
        types = {f.name: f.dataType for f in dataset.schema.fields}
        out = replace_columns(out, {n: label_code(c(n), v, types[n]) for n, v in short.items()})
        for name, values in long.items():
            out = label_join(out, c(name), list_table(out, values, types[name]), name)
        for name, info in self.fitted["tables"].items():
            if name in dataset.columns:
                table = dataset.sparkSession.read.parquet(info["path"])
                out = label_join(out, c(name).cast("string"), table, name)
        return out

    def carry(self, stats: TrainingStats, schema: T.StructType) -> None:
        for name, values in self.fitted["categories"].items():
            known: Frequencies | None = stats.frequencies.get(name)
            stats.forget([name])
            if known is None or not known.complete or not (known.values or known.nulls):
                continue
            code = {v: i for i, v in enumerate(values)}
            pairs = [(float(code[json_value(v)]), n) for v, n in known.values] + [(-1.0, known.nulls)]
            stats.moments[name] = Moments.of_counts(pairs)
        stats.forget(self.fitted["tables"])


def category_texts(df: DataFrame, categories: list[Any], dtype: T.DataType) -> list[str]:
    """The categories as Spark writes them, which is what category tables hold."""
    table = list_table(df, categories, dtype).select("code", F.col("value").cast("string").alias("text"))
    return [r["text"] for r in sorted(table.collect(), key=lambda r: r["code"])]


class _Encode(Step):
    def limit(self) -> int:
        return int(self.option("max_categories", MAX_CATEGORIES))

    def expect(self, stats):
        stats.expect("frequencies", self.columns(stats.df.schema), self.limit())

    def tables(self, stats: TrainingStats, cols: list[str]) -> dict[str, dict[str, Any]]:
        paths = {name: category_table(stats.df, name) for name in cols}
        return {n: {"path": p, "size": stats.df.sparkSession.read.parquet(p).count()} for n, p in paths.items()}


class OneHotEncode(_Encode):
    """``onehot_encode{cols, output="dense"|"sparse"}``.

    dense: int columns ``col_category`` in sorted category order, which become part of
    the schema; a column of more than *max_columns* categories (default 10,000) is an error.
    sparse: one vector ``col_vec`` in the order of the categories' text, for any number of
    categories, which never leave Spark.
    """

    def limit(self):
        return int(self.option("max_columns", MAX_COLUMNS))

    def sparse(self) -> bool:
        output = self.option("output", "dense")
        if output not in ("dense", "sparse"):
            raise ValueError(f"one-hot output is 'dense' or 'sparse', not '{output}'")
        return output == "sparse"

    def expect(self, stats):
        if not self.sparse():
            super().expect(stats)

    def learn(self, stats):
        cols = self.columns(stats.df.schema, warn=True)
        if self.sparse():
            return OneHotModel({"categories": {}, "tables": self.tables(stats, cols)})
        found = stats.need_frequencies(cols, self.limit())
        wide = [n for n, f in found.items() if not f.complete]
        if wide:
            raise ValueError(f"more than {self.limit()} categories in {wide}; use output='sparse' or a larger max_columns")
        lists = {n: [json_value(v) for v in sorted(v for v, _ in f.values)] for n, f in found.items()}
        return OneHotModel({"categories": lists, "tables": {}})


class LabelEncode(_Encode):
    """``label_encode{cols, max_categories}``: code by text order of the value, so "10" < "2"."""

    def learn(self, stats):
        cols = self.columns(stats.df.schema, warn=True)
        types = {f.name: f.dataType for f in stats.df.schema.fields}
        lists, long = {}, []
        for name, f in stats.need_frequencies(cols, self.limit()).items():
            if f.complete:
                values = [json_value(v) for v, _ in f.values]
                texts = dict(zip(values, category_texts(stats.df, values, types[name])))
                lists[name] = sorted(values, key=texts.__getitem__)
            else:
                warnings.warn(
                    f"LabelEncode: '{name}' has more than {self.limit()} categories; using a category table",
                    UserWarning, stacklevel=3)
                long.append(name)
        return LabelEncodeModel({"categories": lists, "tables": self.tables(stats, long)})
