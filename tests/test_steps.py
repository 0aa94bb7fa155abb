import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabloom.functions.stats import Frequencies, Moments, frequencies, moments
from tabloom.operators.derive import LogTransform, PolynomialFeatures
from tabloom.operators.encode import LabelEncode, OneHotEncode
from tabloom.operators.fill import MeanImpute, MedianImpute, ModeImpute
from tabloom.operators.project import DropColumns, RenameColumns, SelectColumns
from tabloom.operators.rescale import MinMaxScale, StandardScale
from tabloom.operators.step import NotFittedError, Step, StepModel
from tabloom.plans.features import STEPS, FeaturePipeline, make_step, register_step, shape_summary

TRAIN = [
    ("gas", "C", 10.0), ("coal", "A", 12.0), ("gas", None, 15.0), ("peat", "B", 9.0), ("coal", "C", 11.0), ("gas", "A", 7.0),
    ("wood", "B", 8.0)]
TEST = [("peat", "A", 1.0), (None, "D", 2.0), ("wind", "B", 3.0), ("wood", None, 4.0)]
SCHEMA = "fuel string, grade string, load double"


@pytest.fixture
def train(frame):
    return frame(TRAIN, SCHEMA)


@pytest.fixture
def test(frame):
    return frame(TEST, SCHEMA)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- encoders ---------------------------------------------------------------------------

def test_onehot_columns_and_unseen(train, test):
    model = OneHotEncode(cols=["fuel"]).fit(train)
    out = model.transform(test)
    assert out.columns == ["grade", "load", "fuel_coal", "fuel_gas", "fuel_peat", "fuel_wood"]
    assert [r[2:] for r in rows(out, "load")] == [(0, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1)]
    assert out.dtypes[-1][1] == "int"


def test_onehot_empty_cols_is_a_noop(train):
    assert OneHotEncode(cols=[]).fit(train).transform(train).columns == train.columns


def test_onehot_missing_column_warns(train):
    with pytest.warns(UserWarning, match="nope"):
        model = OneHotEncode(cols=["nope", "fuel"]).fit(train)
    assert "fuel_gas" in model.transform(train).columns


def test_onehot_name_clash_raises(frame):
    df = frame([("a", 1)], "k string, k_a int")
    with pytest.raises(ValueError, match="already exist"):
        OneHotEncode(cols=["k"]).fit(df).transform(df)


def test_onehot_sparse_output_is_one_vector(train, test):
    model = OneHotEncode(cols=["fuel"], output="sparse").fit(train)
    got = {r["load"]: r["fuel_vec"].toArray().tolist() for r in model.transform(test).collect()}
    assert got == {1.0: [0, 0, 1, 0], 2.0: [0, 0, 0, 0], 3.0: [0, 0, 0, 0], 4.0: [0, 0, 0, 1]}


@pytest.mark.parametrize("limit", [1000, 2])
def test_label_codes(train, test, limit):
    model = LabelEncode(cols=["grade"], max_categories=limit).fit(train)
    assert {r["load"]: r["grade"] for r in model.transform(test).collect()} == {1.0: 0, 2.0: -1, 3.0: 1, 4.0: -1}
    assert dict(model.transform(test).dtypes)["grade"] == "bigint"


def test_label_codes_follow_text_order(frame):
    df = frame([(2,), (10,), (1,)], "n int")
    assert rows(LabelEncode(cols=["n"]).fit(df).transform(df)) == [(0,), (1,), (2,)]
    assert LabelEncode(cols=["n"]).fit(df).fitted["categories"]["n"] == [1, 10, 2]


def test_label_encode_long_list_uses_a_join(frame):
    df = frame([(f"v{i:03d}",) for i in range(200)] + [(None,)], "k string")
    out = rows(LabelEncode(cols=["k"]).fit(df).transform(df))
    assert out == [(-1,)] + [(i,) for i in range(200)]


def test_hot_category_does_not_change_codes(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    with pytest.warns(UserWarning):
        model = LabelEncode(cols=["k"], max_categories=10).fit(df)
    expect = {k: i for i, k in enumerate(sorted({r["k"] for r in df.distinct().collect()}))}
    got = model.transform(df.withColumn("orig", F.col("k"))).groupBy("orig").agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    assert all(r["lo"] == r["hi"] == expect[r["orig"]] for r in got) and len(got) == len(expect)


# --- scalers ------------------------------------------------------------------------------

def test_standard_scale_uses_train_statistics(frame):
    train = frame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "a double")
    model = StandardScale(cols=["a"]).fit(train)
    sd = math.sqrt(1.25)
    assert rows(model.transform(frame([(2.5,), (7.5,)], "a double"))) == [(0.0,), (5.0 / sd,)]
    stats = model.transform(train).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(stats[0]) < 1e-10 and abs(stats[1] - 1) < 1e-10


def test_constant_column_scales_to_zero_even_for_nulls(frame):
    df = frame([(5.0, 1.0), (5.0, 2.0), (None, 3.0)], "a double, b double")
    assert [r[0] for r in rows(StandardScale().fit(df).transform(df), "b")] == [0.0, 0.0, 0.0]
    assert [r[0] for r in rows(MinMaxScale().fit(df).transform(df), "b")] == [0.0, 0.0, 0.0]


def test_minmax_has_no_clipping_and_leaves_others(frame):
    df = frame([(0.0, 10, "x"), (4.0, 20, "y")], "a double, b int, cat string")
    model = MinMaxScale(cols=["a"]).fit(df)
    assert rows(model.transform(frame([(8.0, 1, "z")], "a double, b int, cat string"))) == [(2.0, 1, "z")]
    assert rows(model.transform(df)) == [(0.0, 10, "x"), (1.0, 20, "y")]


def test_all_null_column_stays_null(frame):
    df = frame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in rows(StandardScale().fit(df).transform(df))] == [None, None]
    with pytest.warns(UserWarning, match="stay null"):
        assert [r[0] for r in rows(MeanImpute().fit(df).transform(df))] == [None, None]


# --- imputers -----------------------------------------------------------------------------

def test_imputers(frame):
    df = frame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (None, "a"), (None, None)], "x double, s string")
    assert MedianImpute().fit(df).fitted["values"] == {"x": 2.0}
    assert MeanImpute().fit(df).fitted["values"] == {"x": 7.0 / 3}
    assert ModeImpute().fit(df).fitted["values"] == {"s": "a"}
    assert df.filter("s is null").count() == 1
    assert ModeImpute().fit(df).transform(df).filter("s is null").count() == 0


@pytest.mark.parametrize("values", [(1, 2, None), (1, 3, None), (1, 2, 3), (None, None)])
def test_means_and_medians_are_double_whatever_the_data(frame, values):
    df = frame([(v,) for v in values], "n int")
    for step in (MeanImpute(), MedianImpute()):
        out = step.fit(df).transform(df)
        assert out.dtypes == [("n", "double")]
    known = [v for v in values if v is not None]
    assert rows(MeanImpute().fit(df).transform(df)) == sorted(
        (float(v) if v is not None else (sum(known) / len(known) if known else None),) for v in values)


@pytest.mark.parametrize("n", [5, 1500])
def test_onehot_is_dense_for_any_number_of_categories(spark, n):
    df = spark.range(n).select(F.format_string("k%04d", "id").alias("k"))
    out = OneHotEncode(cols=["k"]).fit(df).transform(df)
    assert out.columns == [f"k_k{i:04d}" for i in range(n)] and {t for _, t in out.dtypes} == {"int"}


@pytest.mark.parametrize("limit", [1000, 2])
def test_label_order_does_not_depend_on_the_limit(frame, limit):
    df = frame([(1e20,), (1.5,), (1e7,), (-0.5,)], "x double")
    model = LabelEncode(cols=["x"], max_categories=limit).fit(df)
    got = model.transform(df.withColumn("v", F.col("x"))).collect()
    # as Spark writes them: -0.5, 1.0E20, 1.0E7, 1.5
    assert {r["v"]: r["x"] for r in got} == {-0.5: 0, 1e20: 1, 1e7: 2, 1.5: 3}


def test_booleans_are_not_numeric(frame):
    df = frame([(True, 1.0), (None, None)], "f boolean, x double")
    with_fill = MeanImpute().fit(df)
    assert set(with_fill.fitted["values"]) == {"x"}


# --- derived and projections ------------------------------------------------------------------

def test_log_transform(frame):
    df = frame([(i, v) for i, v in enumerate([0.0, 1.0, -0.5, -1.0, -2.0, None])], "i int, x double")
    with pytest.warns(UserWarning, match="negative"):
        model = LogTransform(cols=["x"]).fit(df)
    got = [r[1] for r in rows(model.transform(df), "i")]
    assert got[0] == 0.0 and got[3:] == [None, None, None]
    assert got[1] == pytest.approx(math.log(2)) and got[2] == pytest.approx(-math.log(2))


def test_polynomial_features(frame):
    df = frame([(2, 3)], "a int, b int")
    out = PolynomialFeatures(cols=["a", "b"], degree=3).fit(df).transform(df)
    assert out.columns == ["a", "b", "a^2", "a^3", "b^2", "b^3", "a*b"]
    assert rows(out) == [(2, 3, 4.0, 8.0, 9.0, 27.0, 6.0)]
    assert PolynomialFeatures(cols=["a", "b"], degree=1).fit(df).transform(df).columns == ["a", "b", "a*b"]


def test_column_steps(train):
    with pytest.warns(UserWarning, match="nope"):
        assert DropColumns(cols=["grade", "nope"]).fit(train).transform(train).columns == ["fuel", "load"]
    assert SelectColumns(cols=["load", "fuel"]).fit(train).transform(train).columns == ["load", "fuel"]
    assert RenameColumns(mapping={"grade": "g"}).fit(train).transform(train).columns == ["fuel", "g", "load"]


# --- pipeline -----------------------------------------------------------------------------------

PIPE_TRAIN = [
    (1, "gas", 20.0, 3.0), (2, "coal", None, 1.0), (3, "gas", 26.0, None), (4, None, 14.0, 5.0), (5, "peat", None, None),
    (6, "coal", 30.0, 2.0), (7, "gas", 10.0, 9.0)]
PIPE_TEST = [(8, "wind", None, 4.0), (9, "coal", 25.0, None), (10, None, 20.0, 7.0)]
PIPE_SCHEMA = "nr int, fuel string, temp double, load double"
PIPE = [
    {"type": "drop_columns", "cols": ["nr"]}, {"type": "mean_impute", "cols": "all_numeric"},
    {"type": "onehot_encode", "cols": ["fuel"]}, {"type": "standard_scale", "cols": ["temp", "load"]}]


def test_pipeline(frame):
    train, test = frame(PIPE_TRAIN, PIPE_SCHEMA), frame(PIPE_TEST, PIPE_SCHEMA)
    model = FeaturePipeline(PIPE).fit(train)
    assert isinstance(model, PipelineModel)
    out = model.transform(train)
    assert out.columns == ["temp", "load", "fuel_coal", "fuel_gas", "fuel_peat"]
    assert sum(F_nulls(out)) == 0
    means = out.agg(F.avg("temp"), F.avg("load")).first()
    assert abs(means[0]) < 1e-12 and abs(means[1]) < 1e-12
    assert model.stages[1].fitted["values"] == {"temp": 20.0, "load": 4.0}
    unseen, gap, none = model.transform(test).orderBy("load", "temp").collect()
    assert unseen["temp"] == unseen["load"] == 0.0 and unseen[2:] == (0, 0, 0)
    assert gap["load"] == 0.0 and gap["temp"] > 0 and gap[2:] == (1, 0, 0)
    assert none["temp"] == 0.0 and none["load"] > 0 and none[2:] == (0, 0, 0)


def F_nulls(df):
    return list(df.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]).first())


def test_shape_summary(frame):
    train = frame(PIPE_TRAIN, PIPE_SCHEMA)
    got = [tuple(r)[2:] for r in shape_summary(FeaturePipeline(PIPE).fit(train), train).orderBy("step").collect()]
    assert got == [(4, 3, 7), (3, 3, 7), (3, 5, 7), (5, 5, 7)]


def test_unknown_step_and_unfitted(frame):
    with pytest.raises(ValueError, match="mean_impute"):
        FeaturePipeline([{"type": "no_such_step"}])
    with pytest.raises(RuntimeError):
        FeaturePipeline(PIPE).transform(frame(PIPE_TEST, PIPE_SCHEMA))
    with pytest.raises(NotFittedError):
        StandardScale(cols=["temp"]).transform(frame(PIPE_TEST, PIPE_SCHEMA))
    with pytest.raises(ValueError, match="cols must be"):
        OneHotEncode(cols="fuel").fit(frame(PIPE_TRAIN, PIPE_SCHEMA))


LONG = [
    {"type": "rename_columns", "mapping": {"score": "points"}},
    {"type": "median_impute", "cols": ["age"]}, {"type": "mean_impute", "cols": "all_numeric"},
    {"type": "mode_impute", "cols": "all_categorical"}, {"type": "label_encode", "cols": ["town"]},
    {"type": "minmax_scale", "cols": ["age"]}, {"type": "onehot_encode", "cols": ["gender"]},
    {"type": "polynomial_features", "cols": ["age", "points"]}, {"type": "standard_scale", "cols": "all_numeric"}]


def test_carried_statistics_equal_a_step_by_step_fit(spark):
    """The shared-statistics fit and a plain Spark Pipeline learn the same numbers."""
    df = spark.range(500).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 50).cast("double").alias("age"),
        F.when(F.col("id") % 5 != 0, F.rand(3) * 100).alias("score"),
        F.when(F.col("id") % 11 != 0, F.element_at(F.array(F.lit("m"), F.lit("f"), F.lit("x")), (F.col("id") % 3 + 1).cast("int")))
        .alias("gender"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("t"), F.col("id") % 9)).alias("town")).persist()
    pipe = FeaturePipeline(LONG)
    shared = pipe.fit(df)
    plain = Pipeline(stages=[make_step(s) for s in LONG]).fit(df)
    assert pipe.training_scans < len(LONG)
    a, b = shared.stages[-1].fitted["params"], plain.stages[-1].fitted["params"]
    assert a.keys() == b.keys()
    for name in a:
        assert a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-12), name
    assert shared.transform(df).schema == plain.transform(df).schema


def test_carried_values_take_the_new_type(frame):
    df = frame([(1, "a"), (2, None), (None, "b"), (3, "a")], "x int, s string")
    steps = [{"type": "mode_impute", "cols": ["s"]}, {"type": "mean_impute", "cols": ["x"]},
             {"type": "onehot_encode", "cols": ["x"]}]
    shared, plain = FeaturePipeline(steps).fit(df), Pipeline(stages=[make_step(s) for s in steps]).fit(df)
    assert shared.transform(df).columns == plain.transform(df).columns == ["s", "x_1.0", "x_2.0", "x_3.0"]
    assert sorted(map(tuple, shared.transform(df).collect())) == sorted(map(tuple, plain.transform(df).collect()))


def test_stale_heads_are_forgotten():
    head = Frequencies(5, (("a", 4), ("b", 3)), False)
    assert head.filled("z") is None
    assert head.filled("b").values == (("b", 8), ("a", 4))


def test_default_pipeline_scans_each_column_once(frame):
    steps = [{"type": "drop_columns", "cols": ["nr"]}, {"type": "mean_impute"}, {"type": "mode_impute"},
             {"type": "onehot_encode", "cols": ["fuel"]}, {"type": "standard_scale"}]
    pipe = FeaturePipeline(steps)
    pipe.fit(frame(PIPE_TRAIN, PIPE_SCHEMA))
    assert pipe.training_scans == 2       # one for the numbers, one for the categories


def test_save_and_load(frame, tmp_path):
    train = frame(PIPE_TRAIN, PIPE_SCHEMA)
    model = FeaturePipeline(PIPE).fit(train)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert rows(again.transform(train)) == rows(model.transform(train))


class DoubleModel(StepModel):
    def _transform(self, dataset):
        return dataset.withColumn(self.fitted["col"], F.col(self.fitted["col"]) * 2)

    def carry(self, stats, schema):
        stats.forget([self.fitted["col"]])


class Double(Step):
    def learn(self, stats):
        return DoubleModel({"col": self.option("col")})


def test_custom_step(frame):
    register_step("double", Double)
    try:
        train = frame(PIPE_TRAIN, PIPE_SCHEMA)
        model = FeaturePipeline([{"type": "double", "col": "temp"}, {"type": "mean_impute", "cols": ["temp"]}]).fit(train)
        assert model.stages[1].fitted["values"]["temp"] == 40.0
    finally:
        del STEPS["double"]


# --- statistics -------------------------------------------------------------------------------

def test_moments_and_frequencies(frame):
    df = frame([(1.0, "a", True), (3.0, "b", False), (None, "a", True), (None, None, None)], "x double, s string, f boolean")
    m = moments(df, ["x"])["x"]
    assert (m.rows, m.present, m.mean, m.var, m.lo, m.hi) == (4, 2, 2.0, 1.0, 1.0, 3.0)
    filled = m.filled(2.0)
    assert (filled.mean, filled.var) == (2.0, 0.5)
    f = frequencies(df, {"s": 5, "f": 5, "x": 1})
    assert f["s"].values == (("a", 2), ("b", 1)) and f["s"].nulls == 1 and f["s"].complete
    assert f["f"].mode is True and not f["x"].complete and f["x"].mode == 1.0


def test_filled_moments_match_direct(frame):
    values = [1.0, 5.0, 2.5, None, None, 8.0]
    m = moments(frame([(v,) for v in values], "x double"), ["x"])["x"].filled(3.0)
    direct = [3.0 if v is None else v for v in values]
    mean = sum(direct) / 6
    assert m.mean == pytest.approx(mean)
    assert m.var == pytest.approx(sum((v - mean) ** 2 for v in direct) / 6)
    assert Moments.constant(3, 2.0).std == 0.0


def test_head_of_a_column_with_many_values(spark):
    """A third of the rows share one value, the rest are distinct; ties go to the smallest."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("k%05d", "id")).alias("k"))
    f = frequencies(df, {"k": 3})["k"]
    assert f.values == (("hot", 2000), ("k00001", 1), ("k00002", 1)) and not f.complete
