"""Run log: one run per order, with re-logged, deleted and promoted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.plans.runlog import (
    RUN_SCHEMA,
    RunLog,
    activity,
    champion_row,
    compare_runs,
    compare_two,
    current_runs,
    deleted_runs,
    headline_metrics,
    leaderboard,
    leaderboard_text,
    match_run,
    metric_string,
    metrics_long,
    recent_runs,
    run_summary,
    runs_by_tag,
    telemetry,
)
from tabloom.session import scratch_path

from .registry import query, table

MODEL_OF = {
    "1-URGENT": "random_forest", "2-HIGH": "logistic_regression", "3-MEDIUM": "decision_tree",
    "4-NOT SPECIFIED": "ridge", "5-LOW": "lasso",
}
REGRESSION = ("4-NOT SPECIFIED", "5-LOW")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is logged once; status P is logged again with another score;
    low-priority open orders are deleted; urgent finished ones are promoted."""
    o = table(spark, sf_dir, "orders")
    key, price, priority = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    model = F.coalesce(*[F.when(priority == p, m) for p, m in MODEL_OF.items()])

    def part(divisor: int, scale: float):
        return F.floor(price / divisor) / F.lit(scale)

    def record(version: int):
        matrix = F.array(F.array(key, F.lit(0).cast("bigint")), F.array(F.lit(1).cast("bigint"), key))
        scores = F.to_json(F.struct(
            F.lit("classification").alias("task"), part(100 * version, 10000.0).alias("accuracy"),
            part(150 * version, 10000.0).alias("f1_weighted"), matrix.alias("confusion_matrix")))
        errors = F.to_json(F.struct(
            F.lit("regression").alias("task"), part(2, 1000.0).alias("mae"), part(1 * version, 1000.0).alias("rmse")))
        return {
            "run_id": F.md5(key.cast("string")),
            "timestamp": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
            "config": F.to_json(F.struct(model.alias("model"))),
            "pipeline_summary": F.lit("[]"),
            "metrics": F.when(priority.isin(*REGRESSION), errors).otherwise(scores),
            "model_type": model,
            "model_path": F.concat(F.lit("models/"), key.cast("string")),
            "dataset_path": F.lit("orders.parquet"),
            "train_rows": F.col("o_custkey"),
            "test_rows": F.col("o_custkey") + 1,
            "duration_seconds": part(1, 1000.0),
            "tags": F.to_json(F.struct(
                F.when(F.col("o_orderstatus") == "F", "final").otherwise("trial").alias("type"),
                F.lower(priority).alias("queue"))),
            "is_champion": F.lit(False),
        }

    def events(rows: DataFrame, offset: int, kind: str, fields: dict) -> DataFrame:
        none = {f.name: F.lit(None).cast(f.dataType) for f in RUN_SCHEMA.fields}
        return rows.select(
            (key * 10 + offset).alias("seq"), F.lit(kind).alias("event"),
            *[{**none, **fields}[n].cast(RUN_SCHEMA[n].dataType).alias(n) for n in RUN_SCHEMA.names])

    only_id = {"run_id": F.md5(key.cast("string"))}
    return (
        events(o, 0, "log", record(1))
        .unionAll(events(o.filter("o_orderstatus = 'P'"), 1, "log", record(2)))
        .unionAll(events(o.filter("o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"), 2, "delete", only_id))
        .unionAll(events(o.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"), 3, "promote", only_id))
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_runs(run_events(spark, sf_dir))


def stored_log(spark: SparkSession, sf_dir: str) -> RunLog:
    """The log as it is on disk: the first events compacted, later ones after the snapshot."""
    log = RunLog(spark, scratch_path(spark, "run-log"))
    events = run_events(spark, sf_dir)
    events.filter("event = 'log'").write.parquet(log.path)
    log.compact()
    events.filter("event <> 'log'").write.mode("append").parquet(log.path)
    return log


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that use the view more than once: it is worked out once and written."""
    path = scratch_path(spark, "runs-now")
    runs(spark, sf_dir).write.parquet(path)
    return spark.read.schema(RUN_SCHEMA).parquet(path)


CASES = " ".join(f"WHEN '{p}' THEN '{m}'" for p, m in MODEL_OF.items())
# the live runs, worked out from orders directly
RUNS = f"""v AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS ver,
      o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS reg FROM orders
      WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')),
    runs AS (SELECT md5(o_orderkey::VARCHAR) AS run_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
      CASE o_orderpriority {CASES} END AS model_type, o_custkey AS train_rows, o_custkey + 1 AS test_rows,
      floor(o_totalprice) / 1000.0::DOUBLE AS duration_seconds,
      CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'trial' END AS tag_type, lower(o_orderpriority) AS tag_queue,
      CASE WHEN NOT reg THEN floor(o_totalprice / (100 * ver)) / 10000.0::DOUBLE END AS accuracy,
      CASE WHEN NOT reg THEN floor(o_totalprice / (150 * ver)) / 10000.0::DOUBLE END AS f1_weighted,
      CASE WHEN reg THEN floor(o_totalprice / 2) / 1000.0::DOUBLE END AS mae,
      CASE WHEN reg THEN floor(o_totalprice / ver) / 1000.0::DOUBLE END AS rmse,
      o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
        AS is_champion, o_orderkey, reg FROM v)"""
VISIBLE = ["run_id", "timestamp", "model_type", "model_path", "train_rows", "test_rows", "duration_seconds", "is_champion"]


@query("run_log_current", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type, 'models/' || o_orderkey::VARCHAR AS model_path,
    train_rows, test_rows, duration_seconds, is_champion, '{{"model":"' || model_type || '"}}' AS config,
    '[]' AS pipeline_summary, 'orders.parquet' AS dataset_path,
    '{{"type":"' || tag_type || '","queue":"' || tag_queue || '"}}' AS tags,
    CASE WHEN reg THEN 'regression' ELSE 'classification' END AS task, accuracy, f1_weighted, mae, rmse,
    CASE WHEN NOT reg THEN '[[' || o_orderkey || ',0],[1,' || o_orderkey || ']]' END AS confusion_matrix FROM runs""")
def _(spark, sf_dir):
    # all fields; the metrics are taken apart, as engines write numbers in JSON differently
    texts = {n: F.get_json_object("metrics", f"$.{n}") for n in ("task", "confusion_matrix")}
    numbers = {n: F.get_json_object("metrics", f"$.{n}").cast("double") for n in ("accuracy", "f1_weighted", "mae", "rmse")}
    return runs(spark, sf_dir).select(
        *VISIBLE, "config", "pipeline_summary", "dataset_path", "tags",
        *[v.alias(n) for n, v in {**texts, **numbers}.items()])


@query("run_log_compacted", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type, train_rows, test_rows, duration_seconds,
    is_champion, accuracy, f1_weighted, mae, rmse FROM runs""")
def _(spark, sf_dir):
    numbers = [F.get_json_object("metrics", f"$.{n}").cast("double").alias(n) for n in ("accuracy", "f1_weighted", "mae", "rmse")]
    return stored_log(spark, sf_dir).runs().select(
        "run_id", "timestamp", "model_type", "train_rows", "test_rows", "duration_seconds", "is_champion", *numbers)


@query("run_log_after_delete", """SELECT md5(o_orderkey::VARCHAR) AS run_id FROM orders
    WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'""")
def _(spark, sf_dir):
    return deleted_runs(run_events(spark, sf_dir))


@query("run_metrics_long", f"""WITH {RUNS}, long AS (
    SELECT run_id, model_type, 'accuracy' AS metric, accuracy AS "value" FROM runs UNION ALL
    SELECT run_id, model_type, 'f1_weighted', f1_weighted FROM runs UNION ALL
    SELECT run_id, model_type, 'mae', mae FROM runs UNION ALL SELECT run_id, model_type, 'rmse', rmse FROM runs)
    SELECT * FROM long WHERE "value" IS NOT NULL""")
def _(spark, sf_dir):
    return metrics_long(runs(spark, sf_dir)).drop("timestamp")


@query("run_summary", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type, train_rows, test_rows, duration_seconds,
    is_champion FROM runs""")
def _(spark, sf_dir):
    return run_summary(runs(spark, sf_dir)).drop("metrics")


@query("recent_runs", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type FROM runs ORDER BY "timestamp" DESC, run_id LIMIT 50""")
def _(spark, sf_dir):
    return recent_runs(runs(spark, sf_dir), 50).select("run_id", "timestamp", "model_type")


@query("run_prefix_lookup", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type FROM runs
    WHERE starts_with(run_id, (SELECT substr(max(run_id), 1, 8) FROM runs))""")
def _(spark, sf_dir):
    log = stored_runs(spark, sf_dir)
    prefix = log.agg(F.substring(F.max("run_id"), 1, 8)).first()[0]
    return match_run(log, prefix).select("run_id", "timestamp", "model_type")


@query("champion_row", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type, is_champion FROM runs WHERE is_champion""")
def _(spark, sf_dir):
    return champion_row(runs(spark, sf_dir)).select("run_id", "timestamp", "model_type", "is_champion")


@query("runs_by_tag", f"""WITH {RUNS} SELECT run_id, model_type FROM runs WHERE tag_type = 'final'""")
def _(spark, sf_dir):
    return runs_by_tag(runs(spark, sf_dir), "type", "final").select("run_id", "model_type")


def _top(metric: str, order: str, n: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY {metric} {order}, "timestamp" DESC, run_id) AS INTEGER) AS rank,
    run_id, model_type, "timestamp", {metric} AS "value" FROM runs WHERE {metric} IS NOT NULL
    ORDER BY {metric} {order}, "timestamp" DESC, run_id LIMIT {n}"""


@query("leaderboard", f"WITH {RUNS} {_top('f1_weighted', 'DESC', 10)}")
def _(spark, sf_dir):
    return leaderboard(runs(spark, sf_dir), "f1", 10).select("rank", "run_id", "model_type", "timestamp", "value")


@query("leaderboard_rmse", f"WITH {RUNS} {_top('rmse', 'ASC', 10)}")
def _(spark, sf_dir):
    return leaderboard(runs(spark, sf_dir), "rmse", 10).select("rank", "run_id", "model_type", "timestamp", "value")


@query("run_leaderboard_text", f"""WITH {RUNS}, lead AS (SELECT rmse IS NOT NULL AS by_rmse FROM runs
      WHERE rmse IS NOT NULL OR f1_weighted IS NOT NULL ORDER BY "timestamp" DESC, run_id LIMIT 1),
    s AS (SELECT *, CASE WHEN by_rmse THEN rmse ELSE -f1_weighted END AS o FROM runs, lead)
    SELECT CAST(row_number() OVER (ORDER BY o, "timestamp" DESC, run_id) AS INTEGER) AS rank, substr(run_id, 1, 8) AS short_id,
    model_type, "timestamp", CASE WHEN rmse IS NULL THEN printf('accuracy=%.4f, f1=%.4f', accuracy, f1_weighted)
    ELSE printf('mae=%.4f, rmse=%.4f', mae, rmse) END AS metrics_text
    FROM s WHERE o IS NOT NULL ORDER BY o, "timestamp" DESC, run_id LIMIT 10""")
def _(spark, sf_dir):
    return leaderboard_text(stored_runs(spark, sf_dir), 10)


@query("metric_string", f"""WITH {RUNS} SELECT run_id, CASE WHEN rmse IS NULL THEN
    printf('accuracy=%.4f, f1=%.4f', accuracy, f1_weighted) ELSE printf('mae=%.4f, rmse=%.4f', mae, rmse) END AS metrics_text
    FROM runs""")
def _(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", metric_string().alias("metrics_text"))


@query("primary_metric", f"""WITH {RUNS} SELECT run_id,
    CASE WHEN rmse IS NULL THEN 'f1_weighted' ELSE 'rmse' END AS shown_metric, coalesce(f1_weighted, rmse) AS shown_value,
    CASE WHEN least(abs(coalesce(f1_weighted, rmse)), 1) < 0.5 THEN 'red'
         WHEN least(abs(coalesce(f1_weighted, rmse)), 1) < 0.75 THEN 'amber' ELSE 'normal' END AS shown_band,
    CASE WHEN rmse IS NULL THEN 'f1_weighted' ELSE 'rmse' END AS reported_metric,
    coalesce(f1_weighted, rmse) AS reported_value FROM runs""")
def _(spark, sf_dir):
    return headline_metrics(runs(spark, sf_dir))


# the best three by accuracy and the best two by rmse, next to each other
COMPARED = f"""a AS (SELECT * FROM runs WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, "timestamp" DESC, run_id LIMIT 3),
    b AS (SELECT * FROM runs WHERE rmse IS NOT NULL ORDER BY rmse, "timestamp" DESC, run_id LIMIT 2)"""


@query("compare_runs", f"""WITH {RUNS}, {COMPARED} SELECT run_id, "timestamp", model_type, accuracy, f1_weighted, mae, rmse
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(spark, sf_dir):
    log = stored_runs(spark, sf_dir)
    ids = [r["run_id"] for r in leaderboard(log, "accuracy", 3).orderBy("rank").collect()]
    ids += [r["run_id"] for r in leaderboard(log, "rmse", 2).orderBy("rank").collect()]
    return compare_runs(log, [*ids, "no-such-run"])


@query("compare_two", f"""WITH {RUNS}, {COMPARED}, l AS (SELECT * FROM a ORDER BY accuracy DESC, "timestamp" DESC, run_id LIMIT 1),
    r AS (SELECT * FROM a ORDER BY accuracy DESC, "timestamp" DESC, run_id LIMIT 1 OFFSET 1)
    SELECT 'accuracy' AS metric, l.accuracy AS left_value, r.accuracy AS right_value FROM l, r UNION ALL
    SELECT 'f1_weighted', l.f1_weighted, r.f1_weighted FROM l, r""")
def _(spark, sf_dir):
    log = stored_runs(spark, sf_dir)
    first, second = [r["run_id"] for r in leaderboard(log, "accuracy", 2).orderBy("rank").collect()]
    return compare_two(log, first, second)


@query("run_telemetry", f"""WITH {RUNS} SELECT count(*) AS total_runs, count(DISTINCT model_type) AS model_types,
    round(avg(duration_seconds), 1) AS avg_duration, bool_or(is_champion) AS has_champion FROM runs""")
def _(spark, sf_dir):
    return telemetry(runs(spark, sf_dir))


@query("run_activity", f"""WITH {RUNS}, n AS (SELECT * FROM runs ORDER BY "timestamp" DESC, run_id LIMIT 15),
    s AS (SELECT *, date_diff('second', CAST("timestamp" AS TIMESTAMP), TIMESTAMP '2001-08-03 12:00:00') AS sec FROM n)
    SELECT substr(run_id, 1, 8) AS short_id, model_type, is_champion, CASE WHEN sec < 60 THEN sec || 's ago'
    WHEN sec < 3600 THEN sec // 60 || 'm ago' WHEN sec < 86400 THEN sec // 3600 || 'h ago'
    ELSE sec // 86400 || 'd ago' END AS age FROM s""")
def _(spark, sf_dir):
    return activity(runs(spark, sf_dir), F.lit("2001-08-03 12:00:00").cast("timestamp"))
