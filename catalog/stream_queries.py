"""The same operators fed by streams; results equal those of the batch form."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.operators.split import part
from tabloom.plans.features import FeaturePipeline
from tabloom.plans.models import Trainer
from tabloom.plans.runlog import EVENT_SCHEMA, RunLog, telemetry
from tabloom.session import scratch_path
from tabloom.streaming.streams import EndableStream, file_stream, follow_runs, run_to_table, score_stream, window_profile
from tabloom.streaming.windows import read_windows, reference_profile, watch_windows, window_cells, window_status

from .model_queries import KEY, ORDERS, _parts, orders
from .registry import query, rounded, table
from .run_queries import RUNS, run_events


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, sf_dir, "events.parquet", schema)


# standard scaling makes the sums of squares the number of rows
SCALED_RIDGE = """m AS (SELECT avg(cust) AS mx, stddev_pop(cust) AS sx, avg(day) AS mz, stddev_pop(day) AS sz,
      avg(price) AS my FROM o WHERE split = 'train'),
    z AS (SELECT o.*, (cust - mx) / sx AS zx, (day - mz) / sz AS zd, my FROM o, m),
    s AS (SELECT count(*) + 5.0::DOUBLE AS a, sum(zx * zd) AS b, sum(zx * (price - my)) AS p, sum(zd * (price - my)) AS q
      FROM z WHERE split = 'train'),
    w AS (SELECT (p * a - q * b) / (a * a - b * b) AS w1, (a * q - b * p) / (a * a - b * b) AS w2 FROM s)"""


@query("stream_scoring", f"""WITH {ORDERS}, {SCALED_RIDGE}
    SELECT o_orderkey, round(zx, 6) AS cust, round(zd, 6) AS "day", round(my + w1 * zx + w2 * zd, 5) AS prediction FROM z, w""")
def _(spark, sf_dir):
    """Scaling and a ridge model, fitted once, score orders that arrive in two deliveries with a restart between."""
    train = part(_parts(spark, sf_dir), "train").drop("large")
    scaler = FeaturePipeline([{"type": "standard_scale", "cols": ["cust", "day"]}]).fit(train.drop(*KEY, "price"))
    model = Trainer("ridge", {"alpha": 5.0}, "price", KEY).fit(scaler.transform(train))
    rows = orders(spark, sf_dir).drop("price", "large")
    folder, target, checkpoint = (scratch_path(spark, f"scoring-{n}") for n in ("in", "out", "checkpoint"))
    out = None
    for delivery in (rows.filter("day < 0"), rows.filter("not day < 0 or day is null")):
        delivery.write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, "*.parquet", rows.schema, files_per_batch=4)
        scored = score_stream(PipelineModel([scaler, model]), stream)
        out = run_to_table(scored, path=target, checkpoint=checkpoint)
    return rounded(rounded(out.select("o_orderkey", "cust", "day", "prediction"), "cust", "day"), "prediction", digits=5)


@query("stream_window_counts", """SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_second,
    event_type AS category, count(*) AS n, count_if(value IS NULL)::BIGINT AS n_null, round(avg(value), 6) AS mean_value
    FROM events GROUP BY 1, 2""")
def _(spark, sf_dir):
    # append mode gives the windows that the watermark has closed; the end of the stream closes the rest
    events = EndableStream(_events(spark, sf_dir), "ts", scratch_path(spark, "events-end"))
    profile = window_profile(events.stream, "ts", "event_type", "value")
    target, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-checkpoint")
    run_to_table(profile, path=target, checkpoint=checkpoint)
    events.end()
    closed = run_to_table(profile, path=target, checkpoint=checkpoint)
    return rounded(closed.select(F.unix_seconds("window_start").alias("window_second"), "category", "n", "n_null", "mean_value"))


# the reference is what happened before the middle of the time span; every day is compared with it
DAYS = """mid AS (SELECT CAST((min(epoch(ts)) + max(epoch(ts))) / 2 AS BIGINT) AS m FROM events),
    ref AS (SELECT event_type, value FROM events, mid WHERE epoch(ts) < m),
    d AS (SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS ws, event_type, value FROM events),
    days AS (SELECT DISTINCT ws FROM d),
    kx AS (SELECT ws, value AS v, 0.0::DOUBLE AS r, 1.0::DOUBLE AS n FROM d WHERE value IS NOT NULL
      UNION ALL SELECT ws, value, 1.0, 0.0 FROM ref, days WHERE value IS NOT NULL),
    kc AS (SELECT ws, v, sum(r) AS r, sum(n) AS n FROM kx GROUP BY 1, 2),
    ks AS (SELECT ws, max(abs(d)) AS s, max(tn) AS n_new FROM (SELECT ws, sum(r) OVER o / sum(r) OVER a - sum(n) OVER o / sum(n) OVER a AS d,
      sum(n) OVER a AS tn FROM kc WINDOW o AS (PARTITION BY ws ORDER BY v), a AS (PARTITION BY ws)) WHERE tn > 0 GROUP BY ws),
    cx AS (SELECT ws, event_type, 0 AS r, 1 AS n FROM d WHERE event_type IS NOT NULL
      UNION ALL SELECT ws, event_type, 1, 0 FROM ref, days WHERE event_type IS NOT NULL),
    cc AS (SELECT ws, event_type, sum(r)::DOUBLE AS r, sum(n)::DOUBLE AS n FROM cx GROUP BY 1, 2),
    cs AS (SELECT *, sum(r) OVER a AS tr, sum(n) OVER a AS tn, count(*) OVER a AS k FROM cc WINDOW a AS (PARTITION BY ws)),
    ce AS (SELECT *, (r + n) * tr / (tr + tn) AS er, (r + n) * tn / (tr + tn) AS en, CASE WHEN k = 2 THEN 0.5 ELSE 0 END AS y FROM cs),
    chi AS (SELECT ws, sum(pow(abs(r - er) - least(y, abs(r - er)), 2) / er + pow(abs(n - en) - least(y, abs(n - en)), 2) / en) AS s,
      max(tn) AS n_new FROM ce WHERE tn > 0 GROUP BY ws)"""
WINDOW_SCORES = f"""WITH {DAYS}, scores AS (
    SELECT ws AS window_second, 'value' AS "column", 'kolmogorov-smirnov' AS "method", round(s, 6) AS statistic,
      n_new::BIGINT AS n_new, s > 0.1 AS drifted FROM ks UNION ALL
    SELECT ws, 'event_type', 'chi-square', round(s, 6), n_new::BIGINT, s > 9.487729036781154 FROM chi)"""  # 5 % point, 4 degrees


def _watched(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    reference = events.filter(seconds < round((span.a + span.b) / 2)).select("event_type", "value")
    profile = reference_profile(reference, scratch_path(spark, "reference"))
    stream = EndableStream(_events(spark, sf_dir).select("ts", "event_type", "value"), "ts", scratch_path(spark, "events-end"))
    cells = window_cells(stream.stream, profile, "ts")
    target, checkpoint = scratch_path(spark, "window-drift"), scratch_path(spark, "window-drift-checkpoint")
    watch_windows(cells, profile, target, checkpoint).awaitTermination()
    stream.end()
    watch_windows(cells, profile, target, checkpoint).awaitTermination()
    return read_windows(spark, target), len(profile.columns)


@query("stream_window_drift", f"{WINDOW_SCORES} SELECT * FROM scores")
def _(spark, sf_dir):
    scores, _ = _watched(spark, sf_dir)
    return rounded(scores.select(
        F.unix_seconds("window_start").alias("window_second"), "column", "method", "statistic", "n_new", "drifted"))


@query("stream_window_status", f"""{WINDOW_SCORES} SELECT window_second, count_if(drifted)::BIGINT AS n_drifted,
    CASE count_if(drifted) WHEN 0 THEN 'ok' ELSE 'alert' END AS status FROM scores GROUP BY 1""")
def _(spark, sf_dir):
    return window_status(*_watched(spark, sf_dir)).select(F.unix_seconds("window_start").alias("window_second"), "n_drifted", "status")


def _followed(spark, sf_dir):
    """The run log kept by a stream of its events: logs first, then what was logged again, deleted and promoted."""
    folder, checkpoint = scratch_path(spark, "run-events"), scratch_path(spark, "runs-checkpoint")
    log = RunLog(spark, scratch_path(spark, "followed-runs"))
    events = run_events(spark, sf_dir)
    for later in (F.col("seq") % 10 == 0, F.col("seq") % 10 > 0):  # the last digit is the kind of event
        events.filter(later).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, "*.parquet", EVENT_SCHEMA, files_per_batch=8)
        follow_runs(stream, log, checkpoint, compact_every=2).awaitTermination()
    return log


@query("stream_run_telemetry", """SELECT count(*) AS total_runs, count(DISTINCT o_orderpriority) AS model_types,
    round(avg(floor(o_totalprice) / 1000.0::DOUBLE), 1) AS avg_duration, true AS has_champion FROM orders
    WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')""")
def _(spark, sf_dir):
    return telemetry(_followed(spark, sf_dir).runs())


@query("stream_run_log", f"""WITH {RUNS} SELECT run_id, "timestamp", model_type, train_rows, duration_seconds, is_champion,
    coalesce(f1_weighted, rmse) AS score FROM runs""")
def _(spark, sf_dir):
    score = F.coalesce(*[F.get_json_object("metrics", f"$.{n}").cast("double") for n in ("f1_weighted", "rmse")])
    return _followed(spark, sf_dir).runs().select(
        "run_id", "timestamp", "model_type", "train_rows", "duration_seconds", "is_champion", score.alias("score"))
