"""What grows without a cap, and what stays bounded: classes, strata, value ranges, categories, run-log files."""

import itertools
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

import tabloom.operators.drift as drift
import tabloom.plans.models as models
from tabloom.functions.quantiles import approx_quantiles
from tabloom.functions.ranking import numbered_rows
from tabloom.functions.significance import kolmogorov_exact, kolmogorov_p, kolmogorov_series
from tabloom.operators.drift import ks_statistics, summarise_columns
from tabloom.operators.encode import OneHotEncode
from tabloom.operators.evaluate import confusion_counts, confusion_matrix, evaluate
from tabloom.operators.fill import MedianImpute
from tabloom.operators.split import split_exact
from tabloom.plans.features import FeaturePipeline
from tabloom.plans.models import Trainer, load_model, save_model
from tabloom.plans.runlog import EVENT_SCHEMA, RunLog, current_runs, new_record
from tabloom.session import list_folder, local_frame


@pytest.fixture
def brought(monkeypatch):
    """Numbers of rows that collect() has brought to the driver."""
    seen, collect = [], ClassicDataFrame.collect

    def counted(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(ClassicDataFrame, "collect", counted)
    return seen


# --- categories ----------------------------------------------------------------------------

def test_onehot_beside_unique_texts_brings_few_rows_to_the_driver(spark, brought):
    df = spark.range(20_000).select(
        F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("green")), (F.col("id") % 3 + 1).cast("int")).alias("cat"),
        F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("comment"), F.lit(None).cast("string").alias("gone"))
    pipe = FeaturePipeline([{"type": "mode_impute", "cols": "all_categorical"}, {"type": "onehot_encode", "cols": ["cat"]}])
    out = pipe.fit(df).transform(df)
    assert {"cat_red", "cat_blue", "cat_green", "comment"} <= set(out.columns)
    assert pipe.training_scans == 1 and sum(brought) < 20


def test_onehot_has_a_stated_limit(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError, match="more than 29 categories"):
        OneHotEncode(cols=["k"], max_columns=29).fit(df)
    assert len(OneHotEncode(cols=["k"], max_columns=30).fit(df).transform(df).columns) == 30


# --- strata --------------------------------------------------------------------------------

def brute_quota(sizes, fraction):
    """Largest remainders, ties by name; shares as exact fractions."""
    share = {s: Fraction(str(fraction)) * n for s, n in sizes.items()}
    out = {s: math.floor(v) for s, v in share.items()}
    left = math.ceil(sum(share.values())) - sum(out.values())
    for s in sorted(sizes, key=lambda s: (-(share[s] - out[s]), s))[:left]:
        out[s] += 1
    return out


def test_quotas_of_many_strata(spark):
    rng = random.Random(6)
    sizes = {f"s{k:04d}": rng.choice([1, 1, 2, 3, 5, 9]) for k in range(1500)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "id bigint, s string")
    out = split_exact(df, "id", 0.25, 0.0, target="s", stratify=True)
    got = {r["s"]: r["n"] for r in out.filter("split = 'test'").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {s: got.get(s, 0) for s in sizes} == brute_quota(sizes, 0.25)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_numbered_rows_are_one_order(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    got = numbered_rows(df, [F.col("v").desc(), F.col("id")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(5000))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbered_rows(df.limit(0), [F.col("id")], "place").count() == 0


# --- value ranges and p-values ---------------------------------------------------------------

def test_thousands_of_ranges_give_the_same_statistic(spark, monkeypatch):
    ref = spark.range(4000).select((F.rand(1) * 9).alias("x"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id")).alias("hot"))
    new = spark.range(3000).select((F.rand(2) * 8).alias("x"), F.when(F.col("id") % 4 == 0, 7.0).otherwise(F.col("id")).alias("hot"))
    want = {r["column"]: r["statistic"] for r in ks_statistics(ref, new).collect()}
    monkeypatch.setattr(drift, "RANGE_ROWS", 1)
    assert min(len(x.bounds) for x in summarise_columns(ref)) > 2 * drift.GRID_RANGES
    got = {r["column"]: r["statistic"] for r in ks_statistics(ref, new).collect()}
    assert got == pytest.approx(want, abs=1e-15)


def enumerated(statistic, n, m):
    """Share of all orders of n + m rows whose largest gap is at least the statistic."""
    hits = total = 0
    for places in itertools.combinations(range(n + m), n):
        mine, i, gap = set(places), 0, Fraction(0)
        for k in range(n + m):
            i += k in mine
            gap = max(gap, abs(Fraction(i, n) - Fraction(k + 1 - i, m)))
        hits, total = hits + (gap >= statistic), total + 1
    return hits / total


@pytest.mark.parametrize("n,m", [(3, 4), (5, 5), (2, 7), (1, 1), (6, 4)])
def test_exact_p_value_equals_enumeration(n, m):
    for gap in {abs(Fraction(i, n) - Fraction(j, m)) for i in range(n + 1) for j in range(m + 1)}:
        assert kolmogorov_exact(float(gap), n, m) == pytest.approx(enumerated(gap, n, m), rel=1e-12)


def test_exact_and_asymptotic_p_values_meet():
    assert kolmogorov_exact(0.08, 900, 1100) == pytest.approx(kolmogorov_series(0.08, 900, 1100), rel=0.1)
    assert kolmogorov_p(0.5, 10, 10_001) == kolmogorov_series(0.5, 10, 10_001)
    assert kolmogorov_p(1.0, 40, 40) == pytest.approx(2 / math.comb(80, 40), rel=1e-12)  # a tail far below rounding of 1


# --- approximate medians ----------------------------------------------------------------------

def test_approximate_quantiles_have_a_rank_bound(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(size=30_000), np.full(9_000, 0.4)])
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "x double, e double").repartition(6)
    got = approx_quantiles(df, ["x", "e"], [0.1, 0.5, 0.9])
    for p, v in zip((0.1, 0.5, 0.9), got["x"]):
        assert (x < v).mean() <= p + 0.001 and (x <= v).mean() >= p - 0.001
    assert got["e"] == [None] * 3
    model = MedianImpute(cols=["x"], exact=False).fit(df)
    assert model.fitted["values"]["x"] == pytest.approx(got["x"][1], abs=0.01)


# --- classes ---------------------------------------------------------------------------------

def test_five_thousand_classes(spark, tmp_path):
    df = spark.range(12_000).select(
        F.concat(F.lit("c"), F.format_string("%04d", F.col("id") % 5000)).alias("y"), (F.col("id") % 5000 < 2000).cast("double").alias("a"))
    model = Trainer("decision_tree", {"max_depth": 1}, "y").fit(df)
    save_model(model, str(tmp_path / "m"))
    for fitted in (model, load_model(str(tmp_path / "m"))):
        scored = fitted.transform(df)
        assert scored.columns == ["y", "a", "prediction"] and scored.count() == 12_000
        # 2,000 classes have three rows each, the others two; the smallest of equals wins
        assert {(r["a"], r["prediction"]) for r in scored.select("a", "prediction").distinct().collect()} == {
            (1.0, "c0000"), (0.0, "c2000")}
    assert scored.drop("y").columns == ["a", "prediction"]
    metrics = evaluate(scored, "classification", "y")
    assert "confusion_matrix" not in metrics and metrics["accuracy"] == round(5 / 12_000, 6)
    assert confusion_counts(scored, "y").count() == 5000
    with pytest.raises(ValueError, match="more than 1000 classes"):
        confusion_matrix(scored, "y")


def test_rows_are_scored_once(spark):
    scored = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b

    df = spark.range(900).selectExpr("id % 3 as label", "id % 4 as prediction").mapInArrow(look, "label bigint, prediction bigint")
    metrics = evaluate(df, "classification")
    assert scored.value == 900
    assert metrics["confusion_matrix"] == [[75, 75, 75, 75]] * 3 + [[0, 0, 0, 0]] and metrics["accuracy"] == 0.25
    assert "confusion_matrix" not in evaluate(df, "classification", max_classes=3)


def test_ridge_is_the_same_by_either_solver(spark, monkeypatch):
    df = spark.range(300).select(F.rand(1).alias("a"), (F.rand(2) * 5).alias("b"), (F.rand(3) * 9 + F.col("id") / 50).alias("y"))
    normal = Trainer("ridge", {"alpha": 4.0}, "y").fit(df).stages[-2]
    monkeypatch.setattr(models, "NORMAL_FEATURES", 1)
    other = Trainer("ridge", {"alpha": 4.0}, "y").fit(df).stages[-2]
    assert other.coefficients.toArray() == pytest.approx(normal.coefficients.toArray(), abs=1e-7)
    assert other.intercept == pytest.approx(normal.intercept, abs=1e-6)


# --- run log files ------------------------------------------------------------------------------

def view(runs):
    return sorted(json.dumps(r.asDict(), sort_keys=True) for r in runs.collect())


def test_compaction_keeps_answers_and_bounds_files(spark, tmp_path):
    log, rng, counts = RunLog(spark, str(tmp_path / "log")), random.Random(4), []
    log.compact()  # of an empty log
    assert log.runs().count() == 0
    for step in range(40):
        known = [r.run_id for r in log.runs().select("run_id").collect()]
        if step % 7 == 3:
            log.promote(rng.choice(known))
        elif step % 5 == 4:
            log.delete_run(rng.choice(known))
        else:
            name = rng.choice(known) if known and step % 3 == 0 else f"run-{step:04d}"
            log.log_run(run_id=name, model_type=f"m{step}", model_path="p", timestamp=f"2031-01-01T00:{step:02d}:00")
        if step % 8 == 7:
            before = view(log.runs())
            log.compact()
            assert view(log.runs()) == before
        counts.append(len(log._files()))
    assert max(counts) <= 2 * 8 + 1 and len(list_folder(spark, f"{log.path}/_snapshots")) == 2
    assert log.runs().filter("is_champion").count() <= 1


def test_snapshots_survive_late_events_and_broken_attempts(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.log_runs([new_record(run_id="a", model_type="new"), new_record(run_id="b")])
    log.delete_run("b")
    log.compact()
    (last,) = log._snapshots()

    def late(seq, kind, run):
        record = new_record(run_id=run, model_type="late") if kind == "log" else {"run_id": run}
        values = [json.dumps(v) if isinstance(v, (dict, list)) else v for v in (record.get(n) for n in EVENT_SCHEMA.names[2:])]
        return (seq, kind, *values)

    # a writer whose clock is behind: its events lose, also against a deleted run
    local_frame(spark, [late(5, "log", "a"), late(6, "log", "b")], EVENT_SCHEMA).write.mode("append").parquet(log.path)
    assert [(r.run_id, r.model_type) for r in log.runs().collect()] == [("a", "new")]
    # a compaction that stopped before its list of files
    local_frame(spark, [], EVENT_SCHEMA).write.parquet(last.replace("v-000000000000", "v-000000000001") + "/events")
    assert log._snapshots() == [last] and log.runs().count() == 1
    log.compact()
    assert len(log._snapshots()) == 2 and [(r.run_id, r.model_type) for r in log.runs().collect()] == [("a", "new")]
    assert view(log.runs()) == view(current_runs(log.events()))
