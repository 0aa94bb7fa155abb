import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.ranking import sorted_positions
from tabloom.operators.clean import Cleaner, dedupe_rows, duplicate_count, fix_dtypes
from tabloom.operators.evaluate import classification_metrics, confusion_matrix, evaluate, regression_metrics
from tabloom.operators.split import part, split_exact, split_hash, split_sizes
from tabloom.sources.catalog import list_datasets, preview
from tabloom.sources.readers import READERS, load, register_reader
from tabloom.sources.sinks import read_metrics, save_metrics


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- sources ------------------------------------------------------------------------------

def test_csv_types_and_null_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,flag,s,n\n1,4.5,True,x,NA\n2,NaN,False,"say ""hi"", you",n/a\n3,,True,None,\n')
    df = load(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("flag", "boolean"), ("s", "string"), ("n", "string")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, 4.5, True, "x", None), (2, None, False, 'say "hi", you', None), (3, None, True, None, None)]


def test_csv_with_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,NA\n2,3\n")
    df = load(spark, str(path), schema="b double, a int")
    assert rows(df) == [(3.0, 2), (None, 1)]


@pytest.mark.parametrize("text", ['[{"a": 1, "b": 4.0}, {"a": 2, "b": null}]', '{"a": 1, "b": 4.0}\n{"a": 2, "b": null}\n'])
def test_json_array_and_lines(spark, tmp_path, text):
    path = tmp_path / "t.JSON"
    path.write_text(text)
    assert rows(load(spark, str(path))) == [(1, 4.0), (2, None)]


def test_parquet_nan_is_null(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, math.nan), (2, 3.0)], "a int, x double").write.parquet(path)
    assert rows(load(spark, path)) == [(1, None), (2, 3.0)]


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.xlsx"))
    (tmp_path / "t.txt").write_text("x")
    with pytest.raises(ValueError, match="no reader for"):
        load(spark, str(tmp_path / "t.txt"))
    (tmp_path / "dup.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError, match="case is ignored"):
        load(spark, str(tmp_path / "dup.csv"))


def test_register_reader(spark, tmp_path):
    register_reader(".psv", lambda s, p, schema=None, **o: READERS[".csv"](s, p, schema, sep="|", **o))
    try:
        (tmp_path / "t.psv").write_text("a|b\n1|x\n")
        assert rows(load(spark, str(tmp_path / "t.psv"))) == [(1, "x")]
    finally:
        del READERS[".psv"]


def test_listing_preview_and_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.txt").write_text("x")
    assert [(r["name"], r["size_bytes"]) for r in list_datasets(spark, str(tmp_path)).collect()] == [("a.csv", 4)]
    assert [r["id"] for r in preview(spark.range(100), 3, "id").collect()] == [0, 1, 2]
    metrics = {"task": "classification", "accuracy": 0.5, "confusion_matrix": [[1, 2], [3, 4]]}
    save_metrics(spark, metrics, str(tmp_path / "r" / "report.json"))
    assert read_metrics(spark, str(tmp_path / "r" / "report.json")) == json.loads(json.dumps(metrics))


# --- cleaning -----------------------------------------------------------------------------

GAPS = ([(1.0, None, 0), (None, 40.0, 1), (3.0, 10.0, 0), (8.0, 10.0, None), (None, None, 1)], "w double, h double, flag int")


@pytest.mark.parametrize("strategy,expect", [
    ("mean", [(1.0, 20.0, 0.0), (4.0, 40.0, 1.0), (3.0, 10.0, 0.0), (8.0, 10.0, 0.5), (4.0, 20.0, 1.0)]),
    ("median", [(1.0, 10.0, 0.0), (3.0, 40.0, 1.0), (3.0, 10.0, 0.0), (8.0, 10.0, 0.5), (3.0, 10.0, 1.0)]),
    ("mode", [(1.0, 10.0, 0), (1.0, 40.0, 1), (3.0, 10.0, 0), (8.0, 10.0, 0), (1.0, 10.0, 1)]),
    ("drop", [(3.0, 10.0, 0)])])
def test_fill_strategies(frame, strategy, expect):
    assert rows(Cleaner({"fill_nulls": strategy}).clean(frame(*GAPS))) == sorted(expect)


def test_clean_errors_and_duplicates(frame):
    with pytest.raises(ValueError, match="fill_nulls must be one of"):
        Cleaner({"fill_nulls": "guess"})
    df = frame([("x", 1), ("y", None), ("x", 1), ("x", 1), (None, None), ("y", None), ("y", 2)], "k string, n int")
    assert dedupe_rows(df).count() == 4 and duplicate_count(df).first()[0] == 3
    assert Cleaner({"drop_duplicates": False}).clean(df).count() == 7


def test_fix_dtypes(frame):
    df = frame([
        ("10", "north", "n/a", "3f"), ("-2.5", "south", "", "12kg"), (" 4e2 ", "east", "8", "5 5"), ("7", "north", None, "9,1")],
        "amount string, side string, mixed string, unit string")
    out = fix_dtypes(df)
    assert [t for _, t in out.dtypes] == ["double", "string", "double", "string"]
    assert rows(out.select("amount", "mixed")) == [(-2.5, None), (10.0, None), (400.0, 8.0), (7.0, None)]
    assert dict(fix_dtypes(df, min_fraction=0.9).dtypes)["mixed"] == "string"


# --- quantiles ------------------------------------------------------------------------------

@pytest.mark.parametrize("max_state", [2_000_000, 40, 1])
def test_exact_quantiles_equal_sorting(spark, max_state):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(size=10)])
    pdf = [(float(v), int(abs(v) * 10)) for v in x] + [(None, None)] * 50
    df = spark.createDataFrame(pdf, "x double, k int").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "k"], probs, max_state)
    assert got["x"] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    assert got["k"] == pytest.approx(np.quantile([int(abs(v) * 10) for v in x], probs).tolist())


def test_quantiles_of_small_and_empty_columns(frame):
    df = frame([(1.0, None), (2.0, None)], "x double, e double")
    assert exact_quantiles(df, ["x", "e"], [0.5]) == {"x": [1.5], "e": [None]}


def test_sorted_positions(spark):
    df = spark.range(2000).select((F.col("id") % 500).cast("string").alias("v")).union(spark.sql("select cast(null as string)"))
    got = {r["v"]: r["p"] for r in sorted_positions(df, "v", "p").collect()}
    assert got == {v: i for i, v in enumerate(sorted(str(i) for i in range(500)))}


# --- splits -----------------------------------------------------------------------------------

def labelled(spark, n=1000):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.rand(0).alias("feat"),
        F.when(F.col("id") % 3 == 0, "rare").when(F.col("id") % 7 == 1, None).otherwise("common").alias("target"))


def member(df):
    return {r["row_id"]: r["split"] for r in df.collect()}


def test_hash_split_is_reproducible_and_complete(spark):
    df = labelled(spark)
    first, again, other = (member(split_hash(df, "row_id", seed=s)) for s in (1, 1, 2))
    assert first == again and first != other and len(first) == 1000
    assert member(split_hash(df.repartition(13), "row_id", seed=1)) == first
    sizes = {r["split"]: r["n"] for r in split_sizes(split_hash(df, "row_id")).collect()}
    assert sum(sizes.values()) == 1000 and 150 < sizes["test"] < 250


@pytest.mark.parametrize("rank_limit", [1_000_000, 0])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_exact_sizes(spark, n, rank_limit):
    got = member(split_exact(labelled(spark, n), "row_id", rank_limit=rank_limit))
    tests = math.ceil(round(n * 0.2, 9))
    vals = math.ceil(round((n - tests) * 0.125, 9))
    found = list(got.values())
    assert (found.count("test"), found.count("val"), len(found)) == (tests, vals, n)


@pytest.mark.parametrize("local", [1000, 0])
def test_stratified_sizes(spark, monkeypatch, local):
    monkeypatch.setattr("tabloom.operators.split.LOCAL_CLASSES", local)
    df = labelled(spark)
    out = split_exact(df, "row_id", target="target", stratify=True)
    counts = {(r[0], r[1]): r[2] for r in out.groupBy("target", "split").count().collect()}
    assert sum(n for (_, s), n in counts.items() if s == "test") == 200
    assert sum(n for (_, s), n in counts.items() if s == "val") == 100
    for (cls,), n in {(r[0],): r[1] for r in df.groupBy("target").count().collect()}.items():
        assert abs(counts[cls, "test"] - 0.2 * n) < 1 and abs(counts[cls, "val"] - 0.1 * n) < 2


def test_hot_key_in_exact_split(spark):
    """One key holds a third of the rows; those rows stay together, nothing is lost."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("row_id"))
    out = split_exact(df, "row_id", rank_limit=10)
    assert out.count() == 3000
    assert out.filter("row_id = -1").select("split").distinct().count() == 1


def test_split_errors_and_part(spark):
    df = labelled(spark, 20)
    with pytest.raises(KeyError, match="Target"):
        split_hash(df, "row_id", target="nope")
    with pytest.raises(ValueError):
        split_hash(df, "row_id", test_size=0.8, val_size=0.3)
    with pytest.raises(ValueError):
        split_exact(df, "row_id", stratify=True)
    assert part(split_hash(df, "row_id"), "train").columns == df.columns


# --- metrics ------------------------------------------------------------------------------------

GOLDEN = [(0, 0)] * 12 + [(0, 1)] * 18 + [(1, 0)] * 19 + [(1, 1)] * 11


def test_classification_golden(frame):
    df = frame(GOLDEN, "label int, prediction int")
    assert evaluate(df, "classification") == {
        "task": "classification", "accuracy": 0.383333, "f1_weighted": 0.383162, "precision_weighted": 0.383204,
        "recall_weighted": 0.383333, "confusion_matrix": [[12, 18], [19, 11]]}


def test_class_never_predicted_counts_as_zero(frame):
    df = frame([("a", "a"), ("b", "a"), ("a", "c")], "label string, prediction string")
    m = classification_metrics(df).first()
    assert m["precision_weighted"] == round(2 / 3 * 0.5, 6) and m["recall_weighted"] == round(1 / 3, 6)
    cells = {(r[0], r[1]): r[2] for r in confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells["a", "a"] == 1 and cells["c", "c"] == 0


def test_regression_metrics(frame):
    df = frame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    m = regression_metrics(df).first()
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    assert m["mae"] == 0.5 and m["rmse"] == round(float(np.sqrt(((y - p) ** 2).mean())), 6)
    assert m["r2"] == round(float(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()), 6)
    with pytest.raises(TypeError):
        evaluate(df, "clustering")
