import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators.evaluate import classification_metrics, regression_metrics
from tabloom.plans import models
from tabloom.plans.experiment import batch_predict, drift_from_champion, run_experiment
from tabloom.plans.features import FeaturePipeline
from tabloom.plans.models import MODELS, Trainer, load_model, register_model, save_model
from tabloom.plans.runlog import RunLog
from tabloom.plans.tuning import Tuner, sample_params, search_space, study_summary


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    noise = rng.normal(size=400) * 0.1
    rows = [(i, float(a), float(b), int(a + 0.5 * b > 0), float(3 * a - 2 * b + 1 + e), "in" if a * a + b * b < 1.2 else "out",
             ["x", "y", "z"][int(np.digitize(a, [-0.5, 0.5]))])
            for i, ((a, b), e) in enumerate(zip(x, noise))]
    return spark.createDataFrame(
        rows, "row_id bigint, f1 double, f2 double, y int, r double, ring string, three string").coalesce(1).persist()


def matrix(df, *cols):
    return np.array([[float(v) for v in r] for r in df.orderBy("row_id").select(*cols).collect()])


def fit(data, name, params, target):
    train = data.select("row_id", "f1", "f2", target)
    return Trainer(name, params, target, ["row_id"]).fit(train)


def test_logistic_matches_newton(data):
    model = fit(data, "logistic_regression", {"C": 0.5, "max_iter": 200}, "y")
    lr = model.stages[-2]
    x, y = matrix(data, "f1", "f2"), matrix(data, "y")[:, 0]
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(3)
    penalty = np.diag([2.0, 2.0, 0.0])          # 1 / C on the weights only
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(xb.T @ (xb * (p * (1 - p))[:, None]) + penalty, xb.T @ (p - y) + penalty @ w)
    assert np.allclose([*lr.coefficients, lr.intercept], w, atol=1e-5)


def test_ridge_and_lasso_match_closed_forms(data):
    x, y = matrix(data, "f1", "f2"), matrix(data, "r")[:, 0]
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = fit(data, "ridge", {"alpha": 20.0}, "r").stages[-2]
    assert np.allclose(ridge.coefficients, np.linalg.solve(xc.T @ xc + 20 * np.eye(2), xc.T @ yc), atol=1e-9)
    w = np.zeros(2)
    for _ in range(500):
        for j in range(2):
            rest = yc - xc @ w + xc[:, j] * w[j]
            z = xc[:, j] @ rest / len(y)
            w[j] = np.sign(z) * max(abs(z) - 0.3, 0) / (xc[:, j] @ xc[:, j] / len(y))
    lasso = fit(data, "lasso", {"alpha": 0.3}, "r").stages[-2]
    assert np.allclose(lasso.coefficients, w, atol=1e-6)


@pytest.mark.parametrize("name,params,target,least", [
    ("decision_tree", {"max_depth": 6}, "ring", 0.9), ("random_forest", {"n_estimators": 15, "max_depth": 6}, "ring", 0.9),
    ("random_forest_classifier", {"n_estimators": 10, "max_depth": 5, "min_samples_split": 6}, "y", 0.9),
    ("svc", {"C": 10.0, "n_components": 64, "max_iter": 30}, "ring", 0.85), ("svc", {"kernel": "linear", "max_iter": 15}, "three", 0.75),
    ("logistic_regression", {"max_iter": 30}, "three", 0.9)])
def test_classifiers(data, name, params, target, least):
    out = fit(data, name, params, target).transform(data.drop(target).join(data.select("row_id", target), "row_id"))
    assert dict(out.dtypes)["prediction"] == dict(data.dtypes)[target]
    assert classification_metrics(out, target).first()["accuracy"] >= least


@pytest.mark.parametrize("name,params", [
    ("random_forest_regressor", {"n_estimators": 15, "max_depth": 8}), ("robust_regression", {"kernel": "linear", "C": 1e4, "max_iter": 50}),
    ("robust_regression", {"n_components": 200, "C": 1e4, "max_iter": 50})])
def test_regressors(data, name, params):
    out = fit(data, name, params, "r").transform(data)
    assert regression_metrics(out, "r").first()["r2"] > 0.9


def test_model_errors_and_registry(data, tmp_path):
    with pytest.raises(ValueError, match="no model is called"):
        Trainer("knn")
    with pytest.raises(ValueError, match="unsupported model parameters"):
        fit(data, "ridge", {"beta": 1}, "r")
    with pytest.raises(KeyError):
        Trainer("ridge", target="nope").fit(data)
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "none"))
    register_model("plain", "regression", MODELS["ridge"].build)
    try:
        assert fit(data, "plain", {"alpha": 1.0}, "r").transform(data).count() == 400
    finally:
        del MODELS["plain"]


def test_save_load_scores_without_target(data, tmp_path):
    model = fit(data, "svc", {"n_components": 16, "max_iter": 10}, "ring")
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    a, b = (m.transform(data.drop("ring")).orderBy("row_id").select("prediction").collect() for m in (model, again))
    assert a == b and {r[0] for r in a} <= {"in", "out"}


# --- tuning -----------------------------------------------------------------------------------

def test_samples_stay_in_range_and_repeat():
    space = search_space("logistic_regression")
    draws = sample_params(space, 50, seed=3)
    assert all(0.01 <= d["C"] <= 10 and 100 <= d["max_iter"] <= 1000 and d["solver"] in ("lbfgs", "liblinear") for d in draws)
    assert draws[:5] == sample_params(space, 5, seed=3) and draws != sample_params(space, 50, seed=4)
    assert sum(d["C"] < 0.316 for d in draws) > 10          # log scale
    with pytest.raises(ValueError, match="has no search space"):
        search_space("xgboost")


def test_tuning_logs_every_trial(spark, data, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    tuner = Tuner("logistic_regression", 3, "accuracy", run_log=log, model_dir=str(tmp_path / "models"))
    cols = ["row_id", "f1", "f2", "y"]
    best = tuner.tune(data.filter("row_id < 300").select(*cols), data.filter("row_id >= 300").select(*cols), "y", ["row_id"])
    values = sorted(t.value for t in tuner.trials)
    assert best.value >= values[1] and tuner.direction == "maximize"
    summary = study_summary(tuner.trials_frame(data), ["C", "max_iter"])
    assert summary.columns == ["trial", "value", "C", "max_iter"] and summary.count() == 3
    logged = [log.get_run(t.run_id) for t in tuner.trials]
    assert [r["tags"] for r in logged] == [{"type": "trial", "trial_number": str(i), "state": "COMPLETE"} for i in range(3)]
    assert logged[0]["train_rows"] == 300 and logged[0]["test_rows"] == 100
    assert load_model(logged[0]["model_path"]).transform(data).count() == 400
    with pytest.raises(ValueError, match="has no metric"):
        Tuner("ridge", 1, "f1").tune(data.select("row_id", "f1", "r"), data.select("row_id", "f1", "r"), "r", ["row_id"])
    assert Tuner("ridge").metric == "rmse" and Tuner("ridge").direction == "minimize"


def test_failed_trials_are_kept_and_left_out(spark, data, tmp_path):
    def build(params, info):
        if params["a"] > 0.5:
            raise ArithmeticError("no such model")
        return MODELS["ridge"].build({}, info)

    register_model("picky", "regression", build)
    try:
        log = RunLog(spark, str(tmp_path / "runs"))
        tuner = Tuner("picky", 6, "rmse", space={"a": ("uniform", 0.0, 1.0)}, run_log=log)
        cols = data.select("row_id", "f1", "r")
        best = tuner.tune(cols, cols, "r", ["row_id"])
        bad = [t.number for t in tuner.trials if t.params["a"] > 0.5]
        assert 0 < len(bad) < 6 and best.params["a"] <= 0.5
        assert [t.number for t in tuner.trials if t.state == "FAIL"] == bad
        assert log.runs().count() == 6
        assert study_summary(tuner.trials_frame(data), ["a"]).count() == 6 - len(bad)
        with pytest.raises(ArithmeticError):
            Tuner("picky", 2, "rmse", space={"a": ("uniform", 0.6, 1.0)}).tune(cols, cols, "r", ["row_id"])
    finally:
        del MODELS["picky"]


def test_saved_model_holds_its_category_tables(spark, frame, tmp_path):
    train = frame([(i, f"k{i % 9}", float(i % 3)) for i in range(60)], "id int, k string, r double")
    steps = FeaturePipeline([
        {"type": "label_encode", "cols": ["k"], "max_categories": 2}], exclude=["id", "r"]).fit(train)
    model = PipelineModel([*steps.stages, *Trainer("ridge", {}, "r", ["id"]).fit(steps.transform(train)).stages])
    before = {r["id"]: r["prediction"] for r in model.transform(train).collect()}
    save_model(model, str(tmp_path / "m"))
    (tmp_path / "m").rename(tmp_path / "moved")
    again = load_model(str(tmp_path / "moved"))
    assert again.stages[0].fitted["tables"]["k"]["path"].startswith(str(tmp_path / "moved"))
    assert {r["id"]: r["prediction"] for r in again.transform(train).collect()} == before


# --- experiment --------------------------------------------------------------------------------

SPEC = {
    "data": {"target_col": "y"},
    "cleaning": {"fill_nulls": "median"},
    "splitting": {"stratify": True, "random_seed": 1},
    "pipeline": {"steps": [
        {"type": "drop_columns", "cols": ["r"]}, {"type": "onehot_encode", "cols": ["ring"]},
        {"type": "label_encode", "cols": ["three"]}, {"type": "standard_scale", "cols": "all_numeric"}]},
    "model": {"type": "logistic_regression", "params": {"C": 1.0}},
    "tags": {"who": "test"},
}


def test_experiment_to_champion_and_drift(spark, data, tmp_path):
    path = str(tmp_path / "data.parquet")
    data.write.parquet(path)
    log = RunLog(spark, str(tmp_path / "runs"))
    spec = {**SPEC, "data": {"target_col": "y", "filepath": path}}
    result = run_experiment(spark.read.parquet(path), spec, ["row_id"], log, str(tmp_path / "models"), str(tmp_path / "report"))
    assert result.metrics["accuracy"] > 0.9 and sum(result.rows.values()) == 400 and result.rows["test"] == 80
    run = log.get_run(result.run_id)
    assert run["tags"] == {"type": "final", "who": "test"} and run["train_rows"] == result.rows["train"]
    with pytest.raises(FileNotFoundError):
        batch_predict(log, data, ["row_id"])
    log.promote(result.run_id)
    scored = batch_predict(log, data.drop("y"), ["row_id"])
    assert scored.count() == 400 and scored.first()["model_run_id"] == result.run_id
    same = drift_from_champion(spark, log, data)
    assert same.status == "ok" and "row_id" in [r["column"] for r in same.scores.collect()]
    moved = data.withColumn("f1", F.col("f1") + 2)
    assert "f1" in drift_from_champion(spark, log, moved, ["row_id"], "train").features_drifted


def test_tuned_experiment(spark, data):
    spec = {**SPEC, "splitting": {}, "tuning": {"n_trials": 2, "metric": "f1"}}
    spec.pop("cleaning")
    result = run_experiment(data, spec, ["row_id"])
    assert result.metrics["f1_weighted"] > 0.9
    with pytest.raises(KeyError):
        run_experiment(data, {**spec, "data": {"target_col": "zzz"}}, ["row_id"])


def test_trees_give_no_vector_of_all_classes(frame):
    rows = [(i, f"k{i % 1200:04d}", float(i % 2)) for i in range(2400)]
    df = frame(rows, "id bigint, k string, x double")
    for name in ("decision_tree", "random_forest_classifier"):
        params = {"max_depth": 1, **({"n_estimators": 2} if name != "decision_tree" else {})}
        stages = Trainer(name, params, "k", ["id"]).fit(df).stages
        raw = df
        for stage in stages[:-1]:
            raw = stage.transform(raw)
        assert "prediction" in raw.columns and not {"rawPrediction", "probability"} & set(raw.columns)


def test_wide_ridge_is_the_closed_form(spark, frame):
    rng = np.random.default_rng(5)
    size, n = 5000, 60
    x = np.zeros((n, size))
    for i in range(n):
        x[i, rng.choice(size, 3, replace=False)] = rng.normal(size=3)
    x[:, 4999] = 2.0          # a constant column gets no weight
    x[7] = x[8]               # equal rows
    y = rng.normal(size=n) + 50
    vectors = [Vectors.dense(r) if i % 2 else Vectors.sparse(size, np.flatnonzero(r), r[r != 0]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(i, v, float(t)) for i, (v, t) in enumerate(zip(vectors, y))], ["id", "v", "y"])
    df = df.unionByName(df.limit(1).selectExpr("id + 1000 AS id", "v", "CAST(NULL AS double) AS y"))
    model = Trainer("ridge", {"alpha": 2.0}, "y", ["id"]).fit(df)
    centred = x - x.mean(0)
    dual = np.linalg.solve(centred @ centred.T + 2.0 * np.eye(n), y - y.mean())
    want = y.mean() + centred @ (centred.T @ dual)
    got = {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}
    assert sorted(got) == [*range(n), 1000]
    assert [got[i] for i in range(n)] == pytest.approx(want, abs=1e-6)
    assert got[1000] == pytest.approx(want[0], abs=1e-6)


def test_sparse_onehot_and_wide_ridge_name_no_slots(spark):
    df = spark.range(12_000).selectExpr("id", "id % 6000 AS k", "CAST(id % 7 AS double) AS y")
    steps = FeaturePipeline([{"type": "onehot_encode", "cols": ["k"], "output": "sparse"}], exclude=["id", "y"]).fit(df)
    coded = steps.transform(df)
    assert len(str(coded.schema["k_vec"].metadata)) < 200
    model = Trainer("ridge", {"alpha": 1.0}, "y", ["id"]).fit(coded)
    frame = coded
    for stage in model.stages[:2]:
        frame = stage.transform(frame)
    assert len(str(frame.schema["_features"].metadata)) < 200
    first = {r.id: r.prediction for r in model.transform(coded).filter("id < 2").select("id", "prediction").collect()}
    m = sum(i % 7 for i in range(12_000)) / 12_000
    for i in (0, 1):
        pair = [i % 7, (i + 6000) % 7]
        assert first[i] == pytest.approx(m + (sum(pair) - 2 * m) / 3, abs=0.01)


def test_forests_visit_distinct_binned_rows_with_their_bootstrap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "GROUPED_ROWS", 1000)
    df = spark.range(6000).selectExpr(
        "id", "CAST(id % 10 AS double) AS a", "CAST(id DIV 10 % 8 AS double) AS b", "CAST(id DIV 80 % 3 AS double) AS c",
        "IF(id % 10 + id DIV 10 % 8 > 8, 'far', 'near') AS k")
    trainer = Trainer("random_forest_classifier", {"n_estimators": 12, "min_samples_leaf": 20}, "k", ["id"])
    _, ready, info = trainer.prepare(df)
    bins, forest = trainer.kind.build(trainer.params, info)
    rows = forest.bags(bins.transform(ready)).toPandas()
    assert len(rows) == 240 and rows.n.sum() == 6000
    drawn = rows[[f"w{t}" for t in range(12)]].to_numpy()
    # Poisson(n) for n = 25 copies: its mean and variance are 25
    assert drawn.mean() == pytest.approx(25, abs=0.5) and drawn.var() == pytest.approx(25, abs=3)
    assert len({tuple(x) for x in drawn.T}) == 12
    model = trainer.fit(df)
    trees = model.stages[-2].trees
    assert len(trees) == 12 and all(t.numNodes > 1 for t in trees)
    # no leaf has fewer rows of the bootstrap than asked for
    assert all(t.numNodes <= 2 * drawn[:, i].sum() / 20 for i, t in enumerate(trees))
    save_model(model, str(tmp_path / "m"))
    first, again = (m.transform(df.drop("k")).select("id", "prediction").toPandas().sort_values("id") for m in (
        model, load_model(str(tmp_path / "m"))))
    assert first.prediction.tolist() == again.prediction.tolist()
    right = df.select("k", "id").toPandas().sort_values("id")
    assert (right.k.to_numpy() == first.prediction.to_numpy()).mean() > 0.95
    # rows without copies go on to Spark's own bootstrap
    wide = spark.range(2000).selectExpr("id", "rand(1) AS a", "rand(2) AS b", "rand(3) AS c", "CAST(id % 2 AS int) AS k")
    _, _, info = trainer.prepare(wide)
    assert len(trainer.kind.build(trainer.params, info)) == 1
