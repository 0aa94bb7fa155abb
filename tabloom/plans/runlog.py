"""The run log: an append-only event table and the views and rankings over it.

Logging, deleting and promoting a run each append one event row with a ``seq``
number that is unique per run. The current state is a view: the newest log event
per run unless a delete follows it. All functions take and return DataFrames;
:class:`RunLog` adds the table on disk.
"""

from __future__ import annotations

import datetime
import json
import random
import time
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import metric_band, relative_age
from ..operators.evaluate import NON_SCALAR_METRICS, lower_is_better, resolve_metric
from ..session import list_folder, local_frame, path_size, remove_path

# The fields of a run record and those of its list view.
RUN_FIELDS: dict[str, T.DataType] = {
    "run_id": T.StringType(),
    "timestamp": T.StringType(),
    "config": T.StringType(),
    "pipeline_summary": T.StringType(),
    "metrics": T.StringType(),
    "model_type": T.StringType(),
    "model_path": T.StringType(),
    "dataset_path": T.StringType(),
    "train_rows": T.LongType(),
    "test_rows": T.LongType(),
    "duration_seconds": T.DoubleType(),
    "tags": T.StringType(),
    "is_champion": T.BooleanType(),
}
RUN_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in RUN_FIELDS.items()])
SUMMARY_FIELDS = [
    "run_id", "timestamp", "model_type", "metrics", "train_rows", "test_rows", "duration_seconds", "is_champion"]
JSON_FIELDS = ("config", "pipeline_summary", "metrics", "tags")
SHORT_ID = 8
MAX_TAIL = 10_000  # files beside the newest snapshot

EVENT_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("event", T.StringType())] + RUN_SCHEMA.fields)


# --- current state -------------------------------------------------------------------

def current_runs(events: DataFrame) -> DataFrame:
    """One row per live run: its newest log event, with the champion flag worked out.

    A promote clears all champions and marks one run; logging a run again
    replaces the flag by the logged one. So the flag holds for the last promoted
    run, unless logged anew since, and for runs logged as champion after that.
    """
    # the newest event of a run by number alone, then its record: a run whose newest event
    # is a delete finds no record; filters on run_id reach both sides
    last = events.filter(F.col("event").isin("log", "delete")).groupBy("run_id").agg(F.max("seq").alias("seq"))
    newest = events.filter(F.col("event") == "log").join(last, ["run_id", "seq"])
    promoted = events.filter(F.col("event") == "promote").agg(F.max(F.struct("seq", "run_id"))).scalar()
    since = F.coalesce(F.col("seq") > promoted["seq"], F.lit(True))
    logged = F.coalesce(F.col("is_champion"), F.lit(False))
    champion = F.when(since, logged).otherwise(F.col("run_id") == promoted["run_id"])
    return newest.select(*[champion.alias(n) if n == "is_champion" else F.col(n) for n in RUN_SCHEMA.names])


def superseded(events: DataFrame) -> DataFrame:
    """(run_id, seq) of the log and delete events that a newer one of their run replaces."""
    changes = events.filter(F.col("event").isin("log", "delete")).select("run_id", "seq")
    newest = F.max("seq").over(Window.partitionBy("run_id"))
    return changes.withColumn("newest", newest).filter("seq < newest").select("run_id", "seq").distinct()


def compacted(events: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The events that views depend on: the newest log or delete of every run and the newest promote.

    A view over them equals the view over all events, also after events that are older arrive late.
    *old* is :func:`superseded`, if known: while it is small, no record is moved.
    """
    changes = events.filter(F.col("event").isin("log", "delete") & F.col("run_id").isNotNull() & F.col("seq").isNotNull())
    newest = changes.join(superseded(events) if old is None else old, ["run_id", "seq"], "left_anti")
    promotes = events.filter(F.col("event") == "promote")
    promoted = promotes.agg(F.max(F.struct(*EVENT_SCHEMA.names)).alias("e")).filter("e is not null").select("e.*")
    return newest.select(*EVENT_SCHEMA.names).unionAll(promoted)


def deleted_runs(events: DataFrame) -> DataFrame:
    """Runs whose newest log or delete event is a delete."""
    newest = events.filter(F.col("event").isin("log", "delete")).groupBy("run_id").agg(
        F.max_by("event", "seq").alias("event"))
    return newest.filter(F.col("event") == "delete").select("run_id")


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.select(*SUMMARY_FIELDS)


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first; ties by run id."""
    return runs.orderBy(F.col("timestamp").desc(), "run_id").limit(limit)


def match_run(runs: DataFrame, run_id: str) -> DataFrame:
    """Runs with this id; an argument of exactly 8 characters is an id prefix."""
    if len(run_id) == SHORT_ID:
        return runs.filter(F.col("run_id").startswith(run_id))
    return runs.filter(F.col("run_id") == run_id)


def champion_row(runs: DataFrame) -> DataFrame:
    return runs.filter("is_champion").orderBy(F.col("timestamp").desc(), "run_id").limit(1)


def runs_by_tag(runs: DataFrame, key: str, value: str) -> DataFrame:
    return runs.filter(F.try_element_at(json_map("tags"), F.lit(key)) == value)


# --- metrics ---------------------------------------------------------------------------

def json_map(field: str) -> Column:
    """A JSON object column as map<string,string>; nested values stay JSON text."""
    return F.from_json(F.col(field), "map<string,string>")


def scalar_metrics(metrics: Column) -> Column:
    return F.map_filter(metrics, lambda k, v: ~k.isin(*NON_SCALAR_METRICS))


def metric_value(metric: str) -> Column:
    """Value of a metric by name or short form, case ignored; NULL if the run has none."""
    name = resolve_metric(metric)
    hits = F.map_values(F.map_filter(scalar_metrics(json_map("metrics")), lambda k, v: F.lower(k) == name))
    return F.get(hits, F.lit(0)).try_cast("double")


def metrics_long(runs: DataFrame) -> DataFrame:
    """(run_id, timestamp, model_type, metric, value), scalar metrics only."""
    return runs.select(
        "run_id", "timestamp", "model_type", F.explode(scalar_metrics(json_map("metrics"))).alias("metric", "text"),
    ).select("run_id", "timestamp", "model_type", "metric", F.col("text").try_cast("double").alias("value"))


def leaderboard(runs: DataFrame, metric: str = "f1", top_n: int = 5) -> DataFrame:
    """The best *top_n* runs that have the metric, ranked; ties by recency.

    Only the limited result is numbered, so the ranking itself is a top-k.
    """
    value = F.col("value")
    best = runs.withColumn("value", metric_value(metric)).filter(value.isNotNull())
    order = [value.asc() if lower_is_better(metric) else value.desc(), F.col("timestamp").desc(), F.col("run_id")]
    top = best.orderBy(*order).limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def primary_metric(runs: DataFrame) -> str:
    """rmse or f1_weighted, whichever the newest run that has either of them shows."""
    metrics = json_map("metrics")
    choice = F.when(F.map_contains_key(metrics, "rmse"), "rmse").when(
        F.map_contains_key(metrics, "f1_weighted"), "f1_weighted")
    row = (
        runs.select("timestamp", "run_id", choice.alias("choice")).filter("choice is not null")
        .orderBy(F.col("timestamp").desc(), "run_id").limit(1).first()
    )
    return row["choice"] if row is not None else "f1_weighted"


def headline_metrics(runs: DataFrame) -> DataFrame:
    """Per run: the metric a list shows (f1, accuracy, rmse, else the first) and
    the one a finished run reports (f1, rmse, else the first)."""
    metrics = scalar_metrics(json_map("metrics"))
    entries = F.map_entries(metrics)

    def pick(names: list[str]) -> Column:
        found = [
            F.when(F.try_element_at(metrics, F.lit(n)).isNotNull(),
                   F.struct(F.lit(n).alias("key"), F.try_element_at(metrics, F.lit(n)).alias("value")))
            for n in names
        ]
        return F.coalesce(*found, F.get(entries, F.lit(0)))

    shown, reported = pick(["f1_weighted", "accuracy", "rmse"]), pick(["f1_weighted", "rmse"])
    value = shown["value"].try_cast("double")
    return runs.select(
        "run_id",
        shown["key"].alias("shown_metric"),
        value.alias("shown_value"),
        metric_band(value).alias("shown_band"),
        reported["key"].alias("reported_metric"),
        reported["value"].try_cast("double").alias("reported_value"),
    )


def metric_string(field: str = "metrics") -> Column:
    """``accuracy=0.8200, f1=0.8000``: fractions with 4 digits, the rest as they are."""
    entries = F.map_entries(scalar_metrics(json_map(field)))
    shown = F.transform(entries, lambda e: F.concat(
        F.replace(e["key"], F.lit("_weighted"), F.lit("")), F.lit("="),
        F.when(e["value"].rlike(r"^-?\d+(\.\d+([eE]-?\d+)?|[eE]-?\d+)$"),
               F.format_string("%.4f", e["value"].try_cast("double"))).otherwise(e["value"])))
    return F.array_join(shown, ", ")


def leaderboard_text(runs: DataFrame, top_n: int = 10, metric: str | None = None) -> DataFrame:
    """Ranked display rows by the primary metric."""
    best = leaderboard(runs, metric or primary_metric(runs), top_n)
    return best.select(
        "rank", F.substring("run_id", 1, SHORT_ID).alias("short_id"), "model_type", "timestamp",
        metric_string().alias("metrics_text"))


# --- comparison ------------------------------------------------------------------------

def compare_runs(runs: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """Side by side in the order asked for: id, time, model, then every metric any of them has.

    Unknown ids are skipped. The metric names come from the few chosen runs.
    """
    spark = runs.sparkSession
    if not run_ids:
        return runs.select("run_id", "timestamp", "model_type").limit(0)
    named = [
        F.col("run_id").startswith(i) if len(i) == SHORT_ID else F.col("run_id") == i for i in run_ids]
    rows = runs.filter(reduce(Column.__or__, named)).select(
        F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in enumerate(named)]))).alias("pos"),
        "run_id", "timestamp", "model_type", "metrics", F.map_keys(scalar_metrics(json_map("metrics"))).alias("names"))
    # one row per wanted id; an 8-character prefix counts only if it names exactly one run
    found = (
        rows.groupBy("pos").agg(F.count(F.lit(1)).alias("hits"), F.first(F.struct(*rows.columns)).alias("r"))
        .filter("hits = 1").select("r.*").collect())
    found.sort(key=lambda r: r["pos"])
    names = list(dict.fromkeys(n for r in found for n in r["names"] or []))
    chosen = local_frame(
        spark, [(r["pos"], r["run_id"], r["timestamp"], r["model_type"], r["metrics"]) for r in found],
        "pos int, run_id string, timestamp string, model_type string, metrics string")
    metrics = json_map("metrics")
    return chosen.orderBy("pos").select(
        "run_id", "timestamp", "model_type",
        *[F.try_element_at(metrics, F.lit(n)).try_cast("double").alias(n) for n in names])


def compare_two(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Metrics that both runs have, next to each other."""
    def side(run_id: str, name: str) -> DataFrame:
        return metrics_long(match_run(runs, run_id)).select("metric", F.col("value").alias(name))

    return side(left, "left_value").join(side(right, "right_value"), "metric")


# --- display aggregates -----------------------------------------------------------------

def telemetry(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_distinct("model_type").alias("model_types"),
        F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 1).alias("avg_duration"),
        F.coalesce(F.bool_or("is_champion"), F.lit(False)).alias("has_champion"),
    )


def activity(runs: DataFrame, now: Column | None = None, limit: int = 15) -> DataFrame:
    """The newest runs with their age in words."""
    now = F.current_timestamp() if now is None else now
    seconds = F.unix_seconds(now) - F.unix_seconds(F.to_timestamp("timestamp"))
    return recent_runs(runs, limit).select(
        F.substring("run_id", 1, SHORT_ID).alias("short_id"), "model_type", "is_champion",
        relative_age(seconds).alias("age"))


# --- the table on disk --------------------------------------------------------------------

def new_record(**fields: Any) -> dict[str, Any]:
    """A run record with defaults; dict and list fields may be given as objects."""
    record: dict[str, Any] = {
        "run_id": str(uuid.uuid4()),
        "timestamp": datetime.datetime.now().isoformat(),
        "config": {}, "pipeline_summary": [], "metrics": {}, "tags": {},
        "model_type": "", "model_path": "", "dataset_path": "",
        "train_rows": 0, "test_rows": 0, "duration_seconds": 0.0, "is_champion": False,
    }
    unknown = set(fields) - set(record)
    if unknown:
        raise TypeError(f"unknown run fields: {sorted(unknown)}")
    return {**record, **fields}


def _name(file: str) -> str:
    return file.rsplit("/", 1)[1]


def _event(kind: str, record: dict[str, Any]) -> tuple:
    values = []
    for name in RUN_SCHEMA.names:
        value = record.get(name)
        values.append(json.dumps(value) if name in JSON_FIELDS and not isinstance(value, (str, type(None))) else value)
    # the clock to a microsecond, then chance: two writers do not tie
    return (time.time_ns() // 1024 * 1024 + random.randrange(1024), kind, *values)


class RunLog:
    """Event table under *path*; every change is one append.

    Events are in the order of the writers' clocks, so writers need clocks in step. :meth:`compact` writes a
    snapshot of the events that still matter together with the names of the files it covers; views read the
    newest complete snapshot and the files it does not cover.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, *files: str) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(*files)

    def _files(self) -> list[str]:
        """Paths of the event files (their names are unique; folders that start with _ are skipped)."""
        try:
            return self._read(self.path).inputFiles()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _snapshots(self) -> list[str]:
        """Complete snapshots, oldest first: the list of files is written last."""
        root = f"{self.path}/_snapshots"
        return [
            f"{root}/{name}" for name in list_folder(self.spark, root)
            if "_SUCCESS" in list_folder(self.spark, f"{root}/{name}/files")]

    def _covered(self, snapshot: str) -> set[str]:
        return {r.name for r in self.spark.read.schema("name string").parquet(f"{snapshot}/files").collect()}

    def events(self) -> DataFrame:
        """The newest snapshot and all events after it; every event that was never compacted if there is none."""
        return self._events(self._files(), self._snapshots()[-1:])

    def _events(self, files: list[str], snapshots: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(EVENT_SCHEMA).parquet(f"{s}/events") for s in snapshots]
        covered = {name for s in snapshots for name in self._covered(s)}
        tail = [f for f in files if _name(f) not in covered]
        if tail:
            parts.append(self._read(*tail) if covered else self._read(self.path))
        return reduce(DataFrame.unionAll, parts) if parts else local_frame(self.spark, [], EVENT_SCHEMA)

    def has_grown(self, skip: str | None = None) -> bool:
        """Whether what the newest snapshot does not cover is as large as the snapshot, or MAX_TAIL files.

        Compacting only then writes each event a bounded number of times, however many batches there are.
        """
        snapshots = self._snapshots()
        if not snapshots:
            return True
        covered = self._covered(snapshots[-1])
        tail = [f for f in self._files() if _name(f) not in covered and (skip is None or f"/{skip}/" not in f)]
        # files below a subfolder are covered together
        root = _name(self.path)
        places = {f if _name(f.rsplit("/", 1)[0]) == root else f.rsplit("/", 1)[0] for f in tail}
        return len(tail) >= MAX_TAIL or sum(
            path_size(self.spark, p) for p in places) >= path_size(self.spark, f"{snapshots[-1]}/events")

    def compact(self, skip: str | None = None) -> None:
        """Fold all events into a new snapshot, except those in files below the subfolder *skip*.

        Readers keep the files of the snapshot before for one more round: what it covered, and older snapshots,
        are removed only now. Run by one process at a time; one that stops half way leaves the old state valid.
        """
        files = [f for f in self._files() if skip is None or f"/{skip}/" not in f]
        snapshots = self._snapshots()
        number = int(snapshots[-1].rsplit("-", 1)[1]) + 1 if snapshots else 0
        target = f"{self.path}/_snapshots/v-{number:012d}"
        remove_path(self.spark, target)  # what a broken attempt left
        events = self._events(files, snapshots[-1:])
        # written first, so that its size is known when it meets the records
        superseded(events).write.parquet(f"{target}/old")
        old = self.spark.read.schema("run_id string, seq bigint").parquet(f"{target}/old")
        compacted(events, old).write.parquet(f"{target}/events")
        remove_path(self.spark, f"{target}/old")
        local_frame(self.spark, [(_name(f),) for f in files], "name string").coalesce(1).write.parquet(f"{target}/files")
        for snapshot in snapshots[-1:]:
            old = self._covered(snapshot)
            for f in files:
                if _name(f) in old:
                    remove_path(self.spark, f)
        for snapshot in snapshots[:-1]:
            remove_path(self.spark, snapshot)

    def _append(self, rows: list[tuple]) -> None:
        local_frame(self.spark, rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        return current_runs(self.events())

    def log_run(self, **fields: Any) -> str:
        return self.log_runs([new_record(**fields)])[0]

    def log_runs(self, records: list[dict[str, Any]]) -> list[str]:
        self._append([_event("log", r) for r in records])
        return [r["run_id"] for r in records]

    def get_run(self, run_id: str) -> dict[str, Any]:
        """The run as a dict with its JSON fields parsed; ValueError if not exactly one."""
        found = match_run(self.runs(), run_id).limit(2).collect()
        if not found:
            raise ValueError(f"there is no run '{run_id}'")
        if len(found) > 1:
            raise ValueError(f"more than one run starts with '{run_id}'")
        return parse_record(found[0].asDict())

    def list_runs(self, limit: int = 50) -> DataFrame:
        return recent_runs(self.runs(), limit)

    def _change(self, kind: str, run_id: str) -> str:
        try:
            full = self.get_run(run_id)["run_id"]
        except ValueError as error:
            raise RuntimeError(f"cannot {kind} run '{run_id}': {error}") from error
        self._append([_event(kind, {"run_id": full})])
        return full

    def delete_run(self, run_id: str) -> None:
        self._change("delete", run_id)

    def promote(self, run_id: str) -> None:
        """Make the run the only champion. Its model stays where it was saved; a run without one is refused."""
        try:
            stored = self.get_run(run_id)["model_path"]
        except ValueError as error:
            raise RuntimeError(f"cannot promote run '{run_id}': {error}") from error
        if not stored:
            raise RuntimeError(f"cannot promote run '{run_id}': no model was stored with it")
        self._change("promote", run_id)

    def champion(self) -> dict[str, Any] | None:
        row = champion_row(self.runs()).first()
        return parse_record(row.asDict()) if row is not None else None


def parse_record(record: dict[str, Any]) -> dict[str, Any]:
    """JSON fields to objects; text that is not JSON stays as it is."""
    out = dict(record)
    for name in JSON_FIELDS:
        try:
            out[name] = json.loads(out[name]) if out[name] is not None else None
        except (TypeError, ValueError):
            pass
    out["is_champion"] = bool(out["is_champion"])
    return out
