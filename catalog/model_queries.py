"""Model training, tuning, scoring and whole experiments.

Ridge and lasso with few features have closed forms, and so have one cut on one
discrete feature and the majority of a category; those predictions are checked in
SQL. At default settings, models are held to bounds over all test rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.evaluate import confusion_counts, evaluate
from tabloom.operators.split import part, split_hash
from tabloom.plans.experiment import batch_predict, drift_from_champion, run_experiment
from tabloom.plans.features import FeaturePipeline
from tabloom.plans.models import Trainer
from tabloom.plans.runlog import RunLog
from tabloom.plans.tuning import Tuner, sample_params, search_space, study_summary
from tabloom.session import local_frame, scratch_path
from tabloom.sources.readers import load

from .monitor_queries import chi2_sql, ks_sql
from .registry import query, rounded, table

KEY = ["o_orderkey"]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with numeric features, a regression target and a class target."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") / 1000).alias("cust"),
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double").alias("day"),
        (F.col("o_totalprice") / 1000).alias("price"),
    )
    return df.withColumn("large", (F.col("price") + F.col("day") / 20 > 280).cast("int"))


ORDERS = """b AS (SELECT o_orderkey, o_custkey / 1000.0::DOUBLE AS cust,
      date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS day, o_totalprice / 1000.0::DOUBLE AS price,
      ('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders),
    o AS (SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split FROM b)"""


def _parts(spark, sf_dir):
    return split_hash(orders(spark, sf_dir), KEY)


RIDGE = """m AS (SELECT avg(cust) AS mx, avg(day) AS mz, avg(price) AS my FROM o WHERE split = 'train'),
    s AS (SELECT sum((cust - mx) * (cust - mx)) + 5 AS a, sum((cust - mx) * (day - mz)) AS b,
      sum((day - mz) * (day - mz)) + 5 AS d, sum((cust - mx) * (price - my)) AS p, sum((day - mz) * (price - my)) AS q
      FROM o, m WHERE split = 'train'),
    w AS (SELECT (p * d - q * b) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM s)"""


@query("train_ridge", f"""WITH {ORDERS}, {RIDGE} SELECT o_orderkey, price,
    round(my + w1 * (cust - mx) + w2 * (day - mz), 5) AS prediction FROM o, m, w WHERE split = 'test'""")
def _(spark, sf_dir):
    parts = _parts(spark, sf_dir).drop("large")
    model = Trainer("ridge", {"alpha": 5.0}, "price", KEY).fit(part(parts, "train"))
    out = model.transform(part(parts, "test")).select("o_orderkey", "price", "prediction")
    return rounded(out, "prediction", digits=5)


LASSO = """m AS (SELECT avg(price) AS mx, avg(y) AS my, count(*) AS n FROM oy WHERE split = 'train'),
    s AS (SELECT sum((price - mx) * (y - my)) / max(n) AS p, sum((price - mx) * (price - mx)) / max(n) AS a
      FROM oy, m WHERE split = 'train'),
    w AS (SELECT sign(p) * greatest(abs(p) - 0.5, 0) / a AS w FROM s)"""


@query("train_lasso", f"""WITH {ORDERS}, oy AS (SELECT *, price * 2 + day / 100 AS y FROM o), {LASSO}
    SELECT o_orderkey, round(my + w * (price - mx), 4) AS prediction FROM oy, m, w WHERE split = 'test'""")
def _(spark, sf_dir):
    parts = _parts(spark, sf_dir).select(
        "o_orderkey", "price", (F.col("price") * 2 + F.col("day") / 100).alias("y"), "split")
    model = Trainer("lasso", {"alpha": 0.5}, "y", KEY).fit(part(parts, "train"))
    return rounded(model.transform(part(parts, "test")).select("o_orderkey", "prediction"), digits=4)


LARGE = "CAST(price + day / 20 > 280 AS INTEGER)"


def _classes_found(name: str, params: dict, features: list[str], bound: float) -> None:
    """Register the model at *params*: all test rows by class, and whether *bound* of each are found."""
    sql = f"""WITH {ORDERS} SELECT {LARGE} AS large, count(*) AS n_rows, TRUE AS found FROM o WHERE split = 'test' GROUP BY 1"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = _parts(spark, sf_dir).select("o_orderkey", *features, "large", "split")
        model = Trainer(name, params, "large", KEY).fit(part(parts, "train"))
        hit = (F.col("large") == F.col("prediction")).cast("double")
        return model.transform(part(parts, "test")).groupBy("large").agg(
            F.count(F.lit(1)).alias("n_rows"), (F.avg(hit) >= bound).alias("found"))

    suffix = "_linear" if params.get("kernel") == "linear" else ""
    query(f"train_{name}{suffix}", sql)(run)


def _prices_explained(name: str, params: dict, bound: float) -> None:
    """Register the model at *params*: the number of test rows, and whether *bound* of the variance is explained."""
    sql = f"WITH {ORDERS} SELECT count(*) AS n_rows, TRUE AS explained FROM o WHERE split = 'test'"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = _parts(spark, sf_dir).select("o_orderkey", "large", "day", "price", "split")
        model = Trainer(name, params, "price", KEY).fit(part(parts, "train"))
        rest = F.avg(F.pow(F.col("price") - F.col("prediction"), 2))
        return model.transform(part(parts, "test")).agg(
            F.count(F.lit(1)).alias("n_rows"), (1 - rest / F.var_pop("price") >= bound).alias("explained"))

    query(f"train_{name}", sql)(run)


# default settings throughout
_classes_found("logistic_regression", {}, ["price", "day"], 0.85)
_classes_found("decision_tree", {}, ["price", "day"], 0.85)
_classes_found("random_forest", {}, ["price", "day"], 0.85)
_classes_found("random_forest_classifier", {}, ["price", "day", "cust"], 0.8)
_classes_found("svc", {}, ["price", "day"], 0.6)
_classes_found("svc", {"kernel": "linear"}, ["price", "day"], 0.6)
_prices_explained("random_forest_regressor", {}, 0.3)
_prices_explained("robust_regression", {"kernel": "linear"}, 0.3)


# --- closed forms: one cut on one discrete feature, and the majority of each category ------------

STEPS_OF = f"""st AS (SELECT *, floor(price / 40) AS step, {LARGE} AS large FROM o),
    tr AS (SELECT * FROM st WHERE split = 'train'),
    cut AS (SELECT c, sum(CASE WHEN step <= c THEN 1 ELSE 0 END)::DOUBLE AS ln,
        sum(CASE WHEN step <= c THEN large ELSE 0 END)::DOUBLE AS lp, count(*)::DOUBLE AS n, sum(large)::DOUBLE AS p
      FROM (SELECT DISTINCT step AS c FROM tr), tr GROUP BY c)"""
GINI = f"""{STEPS_OF}, best AS (SELECT *, n - ln AS rn, p - lp AS rp FROM cut WHERE n > ln
      ORDER BY lp * (ln - lp) / ln + (p - lp) * (n - ln - p + lp) / (n - ln), c LIMIT 1)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).withColumn("step", F.floor(F.col("price") / 40).cast("double"))


@query("train_decision_tree_one_cut", f"""WITH {ORDERS}, {GINI} SELECT o_orderkey, CAST(CASE WHEN step <= c
    THEN 2 * lp > ln ELSE 2 * rp > rn END AS INTEGER) AS prediction FROM st, best WHERE split = 'test'""")
def _(spark, sf_dir):
    parts = _parts(spark, sf_dir).withColumn("step", F.floor(F.col("price") / 40).cast("double")).select(
        "o_orderkey", "step", "large", "split")
    model = Trainer("decision_tree", {"max_depth": 1}, "large", KEY).fit(part(parts, "train"))
    return model.transform(part(parts, "test")).select("o_orderkey", "prediction")


OFTEN = {"1-URGENT": 8, "2-HIGH": 2, "3-MEDIUM": 7, "4-NOT SPECIFIED": 3, "5-LOW": 9}
MAJORITY = f"""WITH p AS (SELECT o_orderkey, o_orderpriority AS priority, CAST(o_custkey % 10 <
      CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN {v}" for k, v in OFTEN.items())} END AS INTEGER) AS y,
      ('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders),
    m AS (SELECT priority, CAST(avg(y) > 0.5 AS INTEGER) AS prediction FROM p WHERE u >= 0.2 + 0.1 GROUP BY 1)
    SELECT o_orderkey, prediction FROM p JOIN m USING (priority) WHERE u < 0.2"""


def _majority(name: str, params: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        often = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in OFTEN.items()])
        parts = split_hash(table(spark, sf_dir, "orders").select(
            "o_orderkey", F.col("o_orderpriority").alias("priority"),
            (F.col("o_custkey") % 10 < often).cast("int").alias("y")), KEY)
        steps = FeaturePipeline([{"type": "onehot_encode", "cols": ["priority"]}], exclude=["o_orderkey", "y", "split"])
        fitted = steps.fit(part(parts, "train"))
        model = Trainer(name, params, "y", KEY).fit(fitted.transform(part(parts, "train")))
        return model.transform(fitted.transform(part(parts, "test"))).select("o_orderkey", "prediction")

    return run


query("train_logistic_regression_majority", MAJORITY)(_majority("logistic_regression", {}))
query("train_svc_linear_majority", MAJORITY)(_majority("svc", {"kernel": "linear"}))


@query("train_robust_regression_wide", f"""WITH {ORDERS}, oy AS (SELECT *, price * 2 + day / 100 AS y FROM o),
    l AS (SELECT regr_slope(y, price) AS a, regr_intercept(y, price) AS b FROM oy WHERE split = 'train')
    SELECT o_orderkey, round(a * price + b, 1) AS prediction FROM oy, l WHERE split = 'test'""")
def _(spark, sf_dir):
    # with a very large epsilon no residual is an outlier: the least-squares line
    parts = _parts(spark, sf_dir).select(
        "o_orderkey", "price", (F.col("price") * 2 + F.col("day") / 100).alias("y"), "split")
    train = part(parts, "train")
    model = Trainer("robust_regression", {"kernel": "linear", "epsilon": 1e4, "C": 1e6}, "y", KEY).fit(train)
    return rounded(model.transform(part(parts, "test")).select("o_orderkey", "prediction"), digits=1)


# --- more features than normal equations take, more classes than a list holds ---------------------

GROUPED_RIDGE = """p AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem),
    g AS (SELECT l_orderkey, count(*)::DOUBLE AS n, avg(y) AS m FROM p GROUP BY 1),
    b AS (SELECT sum(n / (n + 5) * m) / sum(n / (n + 5)) AS b FROM g)"""


@query("train_ridge_wide", f"""WITH {GROUPED_RIDGE}
    SELECT l_orderkey, l_linenumber, round(b + n * (m - b) / (n + 5), 2) AS prediction FROM p JOIN g USING (l_orderkey), b""")
def _(spark, sf_dir):
    # one sparse feature for every order
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").alias("order"), (F.col("l_extendedprice") / 1000).alias("y"))
    key = ["l_orderkey", "l_linenumber"]
    steps = FeaturePipeline([{"type": "onehot_encode", "cols": ["order"], "output": "sparse"}], exclude=[*key, "y"]).fit(df)
    model = Trainer("ridge", {"alpha": 5.0, "tol": 1e-14}, "y", key).fit(steps.transform(df))
    return rounded(model.transform(steps.transform(df)).select(*key, "prediction"), digits=2)


# one cut between two line statuses; on each side the most frequent part, the smallest of equals
PARTS = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem),
    k AS (SELECT l_linestatus, l_partkey, row_number() OVER (PARTITION BY l_linestatus ORDER BY count(*) DESC, l_partkey) AS r
      FROM p GROUP BY 1, 2),
    f AS (SELECT l_orderkey, l_linenumber, p.l_partkey AS label, k.l_partkey AS prediction FROM p JOIN k USING (l_linestatus) WHERE r = 1)"""


def _many_classes(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber"]
    df = table(spark, sf_dir, "lineitem").select(
        *key, F.col("l_partkey").alias("part"), (F.col("l_linestatus") == "O").cast("double").alias("open"))
    return Trainer("decision_tree", {"max_depth": 1}, "part", key).fit(df).transform(df)


@query("train_many_classes", f"WITH {PARTS} SELECT l_orderkey, l_linenumber, prediction FROM f")
def _(spark, sf_dir):
    return _many_classes(spark, sf_dir).select("l_orderkey", "l_linenumber", "prediction")


@query("evaluate_many_classes", f"""WITH {PARTS}, c AS (SELECT label AS c FROM f UNION SELECT prediction FROM f),
    t AS (SELECT label AS c, count(*) AS sup, count_if(label = prediction) AS tp FROM f GROUP BY 1),
    q AS (SELECT prediction AS c, count(*) AS pr FROM f GROUP BY 1),
    s AS (SELECT coalesce(sup, 0) AS sup, coalesce(tp, 0) AS tp, coalesce(pr, 0) AS pr FROM c LEFT JOIN t USING (c) LEFT JOIN q USING (c))
    SELECT round(sum(tp)::DOUBLE / sum(sup), 6) AS accuracy,
    round(sum(sup * coalesce(2.0 * tp / nullif(pr + sup, 0), 0)) / sum(sup), 6)::DOUBLE AS f1_weighted,
    round(sum(sup * coalesce(tp::DOUBLE / nullif(pr, 0), 0)) / sum(sup), 6)::DOUBLE AS precision_weighted,
    round(sum(sup * coalesce(tp::DOUBLE / nullif(sup, 0), 0)) / sum(sup), 6)::DOUBLE AS recall_weighted,
    (SELECT count(*) FROM (SELECT DISTINCT label, prediction FROM f)) AS cells FROM s""")
def _(spark, sf_dir):
    scored = _many_classes(spark, sf_dir)
    metrics = evaluate(scored, "classification", "part", "prediction")
    names = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted"]
    rows = [(*[metrics[n] for n in names], confusion_counts(scored, "part", "prediction").count())]
    return local_frame(spark, rows, ", ".join(f"{n} double" for n in names) + ", cells bigint")


# --- tuning: ridge with one feature, so each trial has a closed form -----------------------------

N_TRIALS = 20
ALPHAS = [p["alpha"] for p in sample_params(search_space("ridge"), N_TRIALS)]
# a space of its own, in which draws of -1 are refused by the model: those trials fail and the study goes on
BROKEN = {"alpha": ("choice", [0.1, 3.0, 20.0, -1.0, 70.0])}
DONE = [(i, p["alpha"]) for i, p in enumerate(sample_params(BROKEN, N_TRIALS)) if p["alpha"] >= 0]
def _trials(alphas: list[tuple[int, float]]) -> str:
    return f"""{ORDERS}, oy AS (SELECT *, price * 2 + day / 100 AS y FROM o),
    m AS (SELECT avg(price) AS mx, avg(y) AS my FROM oy WHERE split = 'train'),
    s AS (SELECT sum((price - mx) * (y - my)) AS p, sum((price - mx) * (price - mx)) AS a FROM oy, m WHERE split = 'train'),
    g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}::DOUBLE)' for i, a in alphas)}) AS t(trial, alpha)),
    r AS (SELECT trial, alpha, sqrt(avg(pow(y - my - p / (a + alpha) * (price - mx), 2))) AS rmse
      FROM oy, m, s, g WHERE split = 'val' GROUP BY trial, alpha)"""


def _tuned(spark, sf_dir, space=None):
    parts = _parts(spark, sf_dir).select(
        "o_orderkey", "price", (F.col("price") * 2 + F.col("day") / 100).alias("y"), "split")
    tuner = Tuner("ridge", N_TRIALS, space=space)
    best = tuner.tune(part(parts, "train"), part(parts, "val"), "y", KEY)
    return tuner, best, tuner.trials_frame(parts)


@query("tune", f"WITH {_trials(list(enumerate(ALPHAS)))} SELECT round(min(rmse), 6) AS best_value, CAST({N_TRIALS} AS INTEGER) AS n_trials FROM r")
def _(spark, sf_dir):
    tuner, best, _ = _tuned(spark, sf_dir)
    return rounded(local_frame(spark, [(best.value, len(tuner.trials))], "best_value double, n_trials int"))


@query("study_summary", f"WITH {_trials(DONE)} SELECT trial, round(rmse, 6) AS \"value\", round(alpha, 6) AS alpha FROM r")
def _(spark, sf_dir):
    trials = study_summary(_tuned(spark, sf_dir, BROKEN)[2], ["alpha"])
    return trials.select("trial", F.round("value", 6).alias("value"), F.round(F.col("alpha").cast("double"), 6).alias("alpha"))


# --- scoring and experiments ------------------------------------------------------------------

SPEC = {
    "data": {"target_col": "price", "filepath": "orders"},
    "splitting": {"test_size": 0.2, "val_size": 0.1, "random_seed": 42},
    "pipeline": {"steps": [
        {"type": "drop_columns", "cols": ["large"]},
        {"type": "mean_impute", "cols": "all_numeric"},
    ]},
    "model": {"type": "ridge", "params": {"alpha": 5.0}},
}


@query("experiment_metrics", f"""WITH {ORDERS}, {RIDGE},
    t AS (SELECT price AS y, my + w1 * (cust - mx) + w2 * (day - mz) AS f FROM o, m, w WHERE split = 'test')
    SELECT round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse FROM t""")
def _(spark, sf_dir):
    result = run_experiment(orders(spark, sf_dir), SPEC, KEY)
    rows = [(result.metrics["mae"], result.metrics["rmse"])]
    return rounded(local_frame(spark, rows, "mae double, rmse double"))


@query("batch_predict", f"""WITH {ORDERS}, {RIDGE} SELECT o_orderkey,
    round(my + w1 * (cust - mx) + w2 * (day - mz), 5) AS prediction, 'ridge' AS model_type FROM o, m, w""")
def _(spark, sf_dir):
    # train and promote a run, then score every order with the stored champion
    df = orders(spark, sf_dir)
    log = RunLog(spark, scratch_path(spark, "runs"))
    result = run_experiment(df, SPEC, KEY, run_log=log, model_dir=scratch_path(spark, "models"))
    log.promote(result.run_id)
    scored = batch_predict(log, df.drop("price"), KEY)
    return rounded(scored.drop("model_run_id"), digits=5)


# --- a whole experiment: cleaning, imputation, one-hot, scaling and a tuned model ---------------------

FULL_SPEC = {
    "data": {"target_col": "price", "filepath": "orders"},
    "cleaning": {"fill_nulls": "mean", "drop_duplicates": True, "fix_dtypes": True},
    "splitting": {"test_size": 0.2, "val_size": 0.1, "random_seed": 42},
    "pipeline": {"steps": [
        {"type": "mode_impute", "cols": ["queue"]},
        {"type": "onehot_encode", "cols": ["queue"]},
        {"type": "standard_scale", "cols": ["cust"]},
    ]},
    "model": {"type": "ridge"},
    "tuning": {"n_trials": 20, "metric": "rmse"},
}
# Two indicators that add up to one share their weight evenly with opposite signs, which halves their penalty;
# so two equations give every trial, and the best on the validation rows is scored on the test rows.
FULL = f"""raw AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey / 1000.0::DOUBLE END AS cust,
      CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END END AS queue,
      o_totalprice / 1000.0::DOUBLE AS price,
      ('0x' || substr(md5(concat_ws('|', '42', o_orderkey::DOUBLE::VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders),
    o AS (SELECT o_orderkey, coalesce(cust, (SELECT avg(cust) FROM raw)) AS cust, queue, price,
      CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split FROM raw),
    mode AS (SELECT queue AS q FROM o WHERE split = 'train' AND queue IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, queue LIMIT 1),
    m AS (SELECT avg(cust) AS mx, stddev_pop(cust) AS sx FROM o WHERE split = 'train'),
    z AS (SELECT split, price AS y, (cust - mx) / sx AS z, (coalesce(queue, q) = 'high')::INT::DOUBLE AS d FROM o, m, mode),
    c AS (SELECT avg(d) AS md, avg(y) AS my, count(*)::DOUBLE AS n FROM z WHERE split = 'train'),
    s AS (SELECT sum(z * z) AS zz, sum(z * (d - md)) AS zd, sum((d - md) * (d - md)) AS dd, sum(z * (y - my)) AS zy,
      sum((d - md) * (y - my)) AS dy FROM z, c WHERE split = 'train'),
    g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}::DOUBLE)' for i, a in enumerate(ALPHAS))}) AS t(trial, alpha)),
    w AS (SELECT trial, alpha, (zy * (dd + alpha / 2) - dy * zd) / ((zz + alpha) * (dd + alpha / 2) - zd * zd) AS wz,
      (dy * (zz + alpha) - zy * zd) / ((zz + alpha) * (dd + alpha / 2) - zd * zd) AS wd FROM g, s),
    r AS (SELECT trial, alpha, wz, wd, sqrt(avg(pow(y - my - wz * z - wd * (d - md), 2))) AS rmse
      FROM z, c, w WHERE split = 'val' GROUP BY ALL),
    best AS (SELECT * FROM r ORDER BY rmse, trial LIMIT 1),
    t AS (SELECT y, my + wz * z + wd * (d - md) AS f, alpha FROM z, c, best WHERE split = 'test')"""


@query("experiment_full", f"""WITH {FULL} SELECT round(avg(abs(y - f)), 5) AS mae, round(sqrt(avg((y - f) * (y - f))), 5) AS rmse,
    round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 5) AS r2, 21::BIGINT AS runs, count(*) AS test_rows,
    (SELECT count(*) FROM z WHERE split = 'train') AS train_rows FROM t""")
def _(spark, sf_dir):
    """Every order is there twice before cleaning; each trial and the final run are logged.

    Filling by means makes all numbers double, the key included, so the split hashes it as such.
    """
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") / 1000).alias("cust"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.when(F.col("o_orderpriority") < "3", "high").otherwise("low")).alias("queue"),
        (F.col("o_totalprice") / 1000).cast("string").alias("price"))
    log = RunLog(spark, scratch_path(spark, "full-runs"))
    result = run_experiment(df.unionAll(df), FULL_SPEC, KEY, run_log=log)
    m = result.metrics
    rows = [(m["mae"], m["rmse"], m["r2"], log.runs().count(), result.rows["test"], result.rows["train"])]
    return rounded(local_frame(
        spark, rows, "mae double, rmse double, r2 double, runs bigint, test_rows bigint, train_rows bigint"), digits=5)


@query("drift_from_champion", f"""WITH x AS (SELECT false AS is_new, o_totalprice, o_orderstatus FROM orders UNION ALL
      SELECT true, o_totalprice * 1.5::DOUBLE, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
    SELECT 'o_totalprice' AS "column", 'kolmogorov-smirnov' AS "method", round(s, 6) AS statistic, s > 0.1 AS drifted,
      (SELECT count(*) FROM orders) AS reference_rows FROM ({ks_sql('o_totalprice')}) UNION ALL
    SELECT 'o_orderstatus', 'chi-square', round(s, 6), exp(-s / 2) < 0.05, (SELECT count(*) FROM orders)
      FROM ({chi2_sql('o_orderstatus')})""")
def _(spark, sf_dir):
    # train and promote a run, then look up its data set and compare dearer late orders with it
    path = f"{sf_dir.rstrip('/')}/orders.parquet"
    spec = {**SPEC, "data": {"target_col": "price", "filepath": path}}
    log = RunLog(spark, scratch_path(spark, "champion-runs"))
    log.promote(run_experiment(orders(spark, sf_dir), spec, KEY, run_log=log, model_dir=scratch_path(spark, "models")).run_id)
    new = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select(
        (F.col("o_totalprice") * 1.5).alias("o_totalprice"), "o_orderstatus")
    report = drift_from_champion(spark, log, new)
    rows = F.lit(load(spark, log.champion()["dataset_path"]).count()).cast("bigint").alias("reference_rows")
    return rounded(report.scores.select("column", "method", "statistic", "drifted", rows), "statistic")
