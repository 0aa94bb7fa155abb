import datetime
import math

import pytest
from pyspark.sql import functions as F

import tabloom.operators.drift as drift
from tabloom.functions.significance import chi2_p, kolmogorov_series
from tabloom.operators.drift import chi2_statistics, detect_drift, drift_status, ks_statistics
from tabloom.plans import runlog
from tabloom.plans.runlog import RunLog, new_record
from tabloom.sources.sinks import append_drift, latest_drift

# --- drift --------------------------------------------------------------------------------


def numbers(spark, lo, hi):
    return spark.range(lo, hi + 1).select(F.col("id").cast("double").alias("v"))


def labels(spark, **counts):
    rows = [(k,) for k, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "k string")


def test_ks_same_shifted_and_threshold(spark):
    same = detect_drift(numbers(spark, 1, 100), numbers(spark, 1, 100))
    assert same.status == "ok" and same.scores.first()["statistic"] == 0.0 and same.scores.first()["p_value"] == 1.0
    moved = detect_drift(numbers(spark, 1, 100), numbers(spark, 51, 150)).scores.first()
    assert moved["statistic"] == 0.5 and moved["drifted"]
    edge = detect_drift(numbers(spark, 1, 10), numbers(spark, 2, 11)).scores.first()
    assert edge["statistic"] == pytest.approx(0.1) and edge["drifted"] == (edge["statistic"] > 0.1)


@pytest.mark.parametrize("range_rows", [4_000_000, 40])
def test_ks_is_the_same_however_values_are_ranged(spark, monkeypatch, range_rows):
    monkeypatch.setattr(drift, "RANGE_ROWS", range_rows)
    ref = spark.range(3000).select((F.rand(1) * F.rand(2)).alias("x"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("h"))
    new = spark.range(2000).select(F.rand(3).alias("x"), F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id")).alias("h"))
    got = {r["column"]: r["statistic"] for r in ks_statistics(ref.repartition(7), new).collect()}
    for col in ("x", "h"):
        a = sorted(r[0] for r in ref.select(col).collect())
        b = sorted(r[0] for r in new.select(col).collect())
        assert got[col] == pytest.approx(brute_ks(a, b), abs=1e-15)


def brute_ks(a, b):
    import bisect

    return max(abs(bisect.bisect_right(a, v) / len(a) - bisect.bisect_right(b, v) / len(b)) for v in {*a, *b})


def test_chi2_with_and_without_correction(spark):
    three = chi2_statistics(labels(spark, A=50, B=30, C=20), labels(spark, A=20, B=30, C=50)).first()
    assert three["statistic"] == pytest.approx(25.714286, abs=1e-6) and three["k"] == 3
    two = chi2_statistics(labels(spark, A=60, B=40), labels(spark, A=40, B=60)).first()
    assert two["statistic"] == pytest.approx(7.22)


def test_skipped_columns_stay_in_the_denominator(spark):
    ref = spark.createDataFrame([(1.0, "a", None, 1), (2.0, "a", None, 2)], "v double, one string, nothing double, ID int")
    new = spark.createDataFrame([(1.0, "a", 1.0, 1), (9.0, "a", 2.0, 2)], "v double, one string, nothing double, ID int")
    report = detect_drift(ref, new)
    assert (report.n_compared, report.n_tested, report.features_drifted) == (3, 1, ["v"])
    assert report.status == "alert"
    assert detect_drift(ref.select("one"), new.select("one")).scores.count() == 0


def test_boolean_is_numeric_and_mixed_types_are_text(spark):
    ref = spark.createDataFrame([(True, 1), (False, 2)], "f boolean, m int")
    new = spark.createDataFrame([(True, "1"), (True, "3")], "f boolean, m string")
    methods = {r["column"]: r["method"] for r in detect_drift(ref, new).scores.collect()}
    assert methods == {"f": "kolmogorov-smirnov", "m": "chi-square"}


def test_status():
    assert [drift_status(n, 10) for n in (0, 1, 3, 4)] == ["ok", "warning", "warning", "alert"]
    assert drift_status(0, 0) == "ok"


def test_p_values():
    assert chi2_p(3.841458820694124, 1) == pytest.approx(0.05) and chi2_p(5.42824, 4) == pytest.approx(0.24611, abs=1e-5)
    assert chi2_p(0.0, 3) == 1.0 and chi2_p(600.0, 500) == pytest.approx(0.00142, abs=5e-4)
    lam = 1.3580986393225505
    assert kolmogorov_series(lam / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-6)
    assert kolmogorov_series(0.0, 10, 10) == 1.0


def test_drift_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for day, hi in ((1, 100), (2, 150)):
        append_drift(detect_drift(numbers(spark, 1, 100), numbers(spark, hi - 99, hi)), path, datetime.datetime(2024, 1, day))
    latest = latest_drift(spark.read.parquet(path)).collect()
    assert len(latest) == 1 and latest[0]["statistic"] == 0.5 and latest[0]["status"] == "alert"


# --- run log --------------------------------------------------------------------------------

RUNS = [
    ("gannet-one", "decision_tree", {"task": "regression", "mae": 2.0, "rmse": 3.5, "r2": 0.4}, 12.0),
    ("heron-two", "lasso", {"task": "regression", "rmse": 2.25, "mae": 1.5}, 4.0),
    ("ibis-three", "svc", {"task": "classification", "accuracy": 0.58, "f1_weighted": 0.5, "confusion_matrix": [[5, 2], [3, 4]]}, 20.0),
    ("jackdaw-four", "svc", {"task": "classification", "accuracy": 0.91}, 7.0),
]


@pytest.fixture
def log(spark, tmp_path):
    store = RunLog(spark, str(tmp_path / "runs"))
    store.log_runs([
        new_record(run_id=i, model_type=m, metrics=x, duration_seconds=d, timestamp=f"2025-03-0{n}T00:00:00", tags={"n": str(n)},
                   model_path=f"models/{i}")
        for n, (i, m, x, d) in enumerate(RUNS, 1)])
    return store


def ids(df):
    return [r["run_id"] for r in df.collect()]


def test_log_get_and_order(log):
    run = log.get_run("heron-two")
    assert run["metrics"]["rmse"] == 2.25 and run["tags"] == {"n": "2"} and run["is_champion"] is False
    assert ids(log.list_runs()) == ["jackdaw-four", "ibis-three", "heron-two", "gannet-one"]
    assert ids(log.list_runs(1)) == ["jackdaw-four"]
    with pytest.raises(ValueError, match="there is no run"):
        log.get_run("nope")


def test_empty_log(spark, tmp_path):
    store = RunLog(spark, str(tmp_path / "none"))
    assert store.runs().count() == 0 and store.champion() is None


def test_delete_and_relog(log):
    log.delete_run("gannet-one")
    with pytest.raises(ValueError):
        log.get_run("gannet-one")
    with pytest.raises(RuntimeError):
        log.delete_run("gannet-one")
    log.log_run(run_id="gannet-one", model_type="ridge")
    assert log.get_run("gannet-one")["model_type"] == "ridge"
    assert log.runs().count() == 4


def test_prefix_lookup(log):
    log.log_runs([new_record(run_id="abcdefgh-1"), new_record(run_id="abcdefgh-2"), new_record(run_id="12345678-9")])
    assert log.get_run("12345678")["run_id"] == "12345678-9"
    with pytest.raises(ValueError, match="more than one run"):
        log.get_run("abcdefgh")
    with pytest.raises(ValueError):
        log.get_run("abcd%fgh")


def test_one_champion(log):
    log.promote("ibis-three")
    log.promote("heron-two")
    assert log.champion()["run_id"] == "heron-two" and log.runs().filter("is_champion").count() == 1
    log.log_run(run_id="heron-two", model_type="lasso", model_path="models/again")         # logged again: not champion any more
    assert log.champion() is None
    log.promote("heron-two")
    log.delete_run("heron-two")
    assert log.champion() is None
    with pytest.raises(RuntimeError):
        log.promote("missing")
    log.log_run(run_id="bare", model_type="lasso")
    with pytest.raises(RuntimeError, match="no model"):
        log.promote("bare")
    assert log.champion() is None


def test_view_aggregates_numbers_only_and_filters_below(log):
    plan = runlog.match_run(log.runs(), "ibis-three")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[run_id" not in plan
    assert plan.count("EqualTo(run_id,ibis-three)") >= 2


def test_leaderboard(log):
    runs = log.runs()
    assert ids(runlog.leaderboard(runs, "f1").orderBy("rank")) == ["ibis-three"]
    assert ids(runlog.leaderboard(runs, "Accuracy", 1).orderBy("rank")) == ["jackdaw-four"]
    assert ids(runlog.leaderboard(runs, "rmse").orderBy("rank")) == ["heron-two", "gannet-one"]
    assert ids(runlog.leaderboard(runs, "r2")) == ["gannet-one"] and runlog.leaderboard(runs, "task").count() == 0


def test_compare(log):
    out = runlog.compare_runs(log.runs(), ["jackdaw-four", "missing", "gannet-one"])
    assert out.columns == ["run_id", "timestamp", "model_type", "accuracy", "mae", "rmse", "r2"]
    assert ids(out) == ["jackdaw-four", "gannet-one"]
    both = runlog.compare_two(log.runs(), "gannet-one", "heron-two").collect()
    assert {r["metric"]: (r["left_value"], r["right_value"]) for r in both} == {"rmse": (3.5, 2.25), "mae": (2.0, 1.5)}


def test_texts(log):
    log.log_run(run_id="kestrel-five", timestamp="2019-06-01T00:00:00", metrics={"steps": 12, "f1_weighted": 0.95})
    rows = runlog.leaderboard_text(log.runs(), metric="f1").orderBy("rank").collect()
    assert [r["metrics_text"] for r in rows] == ["steps=12, f1=0.9500", "accuracy=0.5800, f1=0.5000"]
    assert runlog.primary_metric(log.runs()) == "f1_weighted"  # the newest run has neither
    head = {r["run_id"]: r for r in runlog.headline_metrics(log.runs()).collect()}
    assert head["kestrel-five"]["shown_metric"] == "f1_weighted" and head["ibis-three"]["shown_band"] == "amber"
    assert head["gannet-one"]["shown_metric"] == "rmse" and head["jackdaw-four"]["reported_metric"] == "accuracy"


def test_views(log):
    t = runlog.telemetry(log.runs()).first()
    assert (t["total_runs"], t["model_types"], t["avg_duration"], t["has_champion"]) == (4, 3, 10.8, False)
    assert ids(runlog.runs_by_tag(log.runs(), "n", "2")) == ["heron-two"]
    ages = [r["age"] for r in runlog.activity(log.runs(), F.lit("2025-03-04 00:00:42").cast("timestamp")).collect()]
    assert ages == ["42s ago", "1d ago", "2d ago", "3d ago"]
    assert "config" not in runlog.run_summary(log.runs()).columns
