"""Streams: windows, drift of closed windows, restarts, and the run log kept by a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import tabloom.operators.drift as drift
from tabloom.operators.drift import detect_drift
from tabloom.plans.features import FeaturePipeline
from tabloom.plans.runlog import EVENT_SCHEMA, RunLog, compacted, current_runs, superseded
from tabloom.session import list_folder, local_frame
from tabloom.streaming.streams import (
    EndableStream,
    file_stream,
    follow_runs,
    run_to_table,
    score_stream,
    start_table,
    watch_drift,
    window_profile,
)
from tabloom.streaming.windows import load_profile, read_windows, reference_profile, watch_windows, window_cells

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


def files(df, folder, parts):
    for k in range(parts):
        df.filter(F.pmod(F.hash("event_id"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("options", [{}, {"slide": "12 hours"}, {"session_gap": "30 minutes"}])
def test_windows_equal_batch_once_the_stream_has_ended(spark, events, tmp_path, options):
    stream = EndableStream(file_stream(spark, SF_DIR, "events.parquet", events.schema), "ts", str(tmp_path / "end"))
    profile = window_profile(stream.stream, "ts", "event_type", "value", **options)
    places = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "checkpoint")}
    key = ["window_start", "window_end", "category", "n", "n_null"]
    early = run_to_table(profile, **places).select(*key).collect()
    stream.end()
    every = run_to_table(profile, **places).select(*key).collect()
    assert sorted(every) == sorted(window_profile(events, "ts", "event_type", "value", **options).select(*key).collect())
    assert 0 < len(early) < len(every) and set(early) < set(every)


def test_a_path_needs_its_checkpoint(spark, events):
    with pytest.raises(ValueError, match="both path and checkpoint"):
        run_to_table(file_stream(spark, SF_DIR, "events.parquet", events.schema), path="somewhere")


def test_scoring_stopped_and_restarted_gives_each_row_once(spark, events, tmp_path):
    rows = events.select("event_id", "value", "event_type")
    model = FeaturePipeline([{"type": "standard_scale", "cols": ["value"]}]).fit(rows.select("value"))
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    files(rows, folder, 6)

    def start(trigger=None):
        stream = file_stream(spark, folder, "*.parquet", rows.schema, files_per_batch=1)
        return start_table(score_stream(model, stream), out, checkpoint, trigger=trigger)

    query = start({"processingTime": "200 milliseconds"})
    while not spark.read.schema(rows.schema).parquet(out).count() if list_folder(spark, out) else True:
        query.processAllAvailable() if query.lastProgress else None
    query.stop()
    files(rows.withColumn("event_id", F.col("event_id") + 10_000_000), folder, 2)  # arrives while nothing runs
    start().awaitTermination()
    start().awaitTermination()  # nothing new
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == 2 * rows.count()


def brute_chi2(ref, new):
    kinds = {*ref, *new}
    a, b = sum(ref.values()), sum(new.values())
    total = 0.0
    for k in kinds:
        for seen, size in ((ref.get(k, 0), a), (new.get(k, 0), b)):
            expect = (ref.get(k, 0) + new.get(k, 0)) * size / (a + b)
            off = abs(seen - expect)
            off -= min(0.5, off) if len(kinds) == 2 else 0
            total += off * off / expect
    return total


def brute_ks(ref, new):
    return max(abs(sum(x <= v for x in ref) / len(ref) - sum(x <= v for x in new) / len(new)) for v in {*ref, *new})


@pytest.mark.parametrize("range_rows", [4_000_000, 25])
def test_drift_of_closed_windows(spark, tmp_path, monkeypatch, range_rows):
    """Windows with unseen and missing categories, ties, NULLs, one value, and values beyond the reference."""
    monkeypatch.setattr(drift, "RANGE_ROWS", range_rows)
    rng = random.Random(9)
    ref = [(rng.choice([1.0, 2.5, rng.random() * 9, None]), rng.choice("aab") if k else None, rng.choice("xy")) for k in range(300)]
    day = datetime.datetime(2030, 5, 1)
    rows = []
    for d in range(6):
        for _ in range(40):
            number = {0: 1.0, 1: 50.0, 2: -3.0}.get(d, rng.choice([2.5, rng.random() * 12, None]))
            rows.append((day + datetime.timedelta(days=d, seconds=rng.randrange(86_000)), number,
                         rng.choice("abc") if d % 2 else "a", "z" if d == 5 else rng.choice("xy") if d else None))
    reference = spark.createDataFrame(ref, "v double, k string, two string")
    frame = spark.createDataFrame(rows, "t timestamp, v double, k string, two string")
    profile = reference_profile(reference, str(tmp_path / "profile"))
    assert load_profile(spark, str(tmp_path / "profile")) == profile
    folder = str(tmp_path / "in")
    for d in range(6):  # a file a day, so windows close in different micro-batches
        own = frame.filter(F.to_date("t") == (day + datetime.timedelta(days=d)).date())
        own.coalesce(1).write.mode("append").parquet(folder)
    stream = EndableStream(file_stream(spark, folder, "*.parquet", frame.schema, files_per_batch=1), "t", str(tmp_path / "end"))
    out, checkpoint, seen = str(tmp_path / "out"), str(tmp_path / "checkpoint"), []
    for _ in range(2):
        cells = window_cells(stream.stream, profile, "t")
        watch_windows(cells, profile, out, checkpoint, then=lambda scores, i: seen.append(scores.count())).awaitTermination()
        stream.end()
    got = {(r.window_start.date(), r["column"]): r for r in read_windows(spark, out).collect()}
    want = {}
    for d in range(6):
        mine = [r[1:] for r in rows if r[0].date() == (day + datetime.timedelta(days=d)).date()]
        for i, name in enumerate(("v", "k", "two")):
            a, b = [r[i] for r in ref if r[i] is not None], [r[i] for r in mine if r[i] is not None]
            if b:
                count = lambda xs: {x: xs.count(x) for x in xs}
                want[(day + datetime.timedelta(days=d)).date(), name] = (
                    brute_ks(a, b) if name == "v" else brute_chi2(count(a), count(b)), len(b))
    assert set(got) == set(want) and sum(seen) == len(want)
    for key, (statistic, n) in want.items():
        assert got[key].statistic == pytest.approx(statistic, abs=1e-12) and got[key].n_new == n, key


def test_drift_per_micro_batch_equals_the_batch_report(spark, events, tmp_path):
    reference = events.select("value", "event_type").limit(300)
    profile = reference_profile(reference, str(tmp_path / "profile"))
    stream = file_stream(spark, SF_DIR, "events.parquet", events.schema).select("value", "event_type")
    seen = []
    watch_drift(stream, profile, lambda report, i: seen.append(report)).awaitTermination()
    want = detect_drift(reference, events.select("value", "event_type"))
    (got,) = seen
    assert got.status == want.status and got.n_tested == want.n_tested
    for a, b in zip(got.scores.collect(), want.scores.collect()):
        assert a.asDict() == pytest.approx(b.asDict())


# --- the run log kept by a stream --------------------------------------------------------------

def run_event(seq, kind, run, **fields):
    record = {"run_id": run, "model_type": "lasso", "is_champion": False, **fields} if kind == "log" else {"run_id": run}
    return (seq, kind, *[record.get(n) for n in EVENT_SCHEMA.names[2:]])


DELIVERIES = [
    [run_event(10, "log", "p", model_type="ridge"), run_event(11, "log", "q"), run_event(12, "log", "r")],
    [run_event(20, "promote", "q"), run_event(21, "log", "p", model_type="svc")],
    [run_event(30, "delete", "r"), run_event(13, "log", "p", model_type="late"),
     run_event(11, "log", "q")],  # one older event arrives late, another one again
    [run_event(40, "log", "r", model_type="again"), run_event(41, "delete", "q")],
    [run_event(50, "log", "q", is_champion=True)],
    [run_event(60, "promote", "p"), run_event(5, "promote", "r")],
]


@pytest.mark.parametrize("every", [1, 2, 100])
def test_run_log_is_right_after_every_batch(spark, tmp_path, every):
    folder, checkpoint, log = str(tmp_path / "in"), str(tmp_path / "checkpoint"), RunLog(spark, str(tmp_path / "log"))
    views = []

    def state(runs):
        return sorted((r.run_id, r.model_type, r.is_champion) for r in runs.collect())

    def start():
        stream = file_stream(spark, folder, "*.parquet", EVENT_SCHEMA, files_per_batch=1)
        return follow_runs(stream, log, checkpoint, every, then=lambda kept, i: views.append(state(kept.runs())))

    for some in (DELIVERIES[:4], DELIVERIES[4:]):  # with a restart in between
        for rows in some:
            local_frame(spark, rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        start().awaitTermination()
    wanted = [
        state(current_runs(local_frame(spark, dict.fromkeys(e for rows in DELIVERIES[:k + 1] for e in rows), EVENT_SCHEMA)))
        for k in range(len(DELIVERIES))]
    assert views[:4] == wanted[:4] and views[-2:] == wanted[4:]
    assert wanted[-1] == [("p", "svc", True), ("q", "lasso", False), ("r", "again", False)]


def test_run_log_is_compacted_as_it_grows(spark, tmp_path):
    folder, checkpoint, log = str(tmp_path / "in"), str(tmp_path / "checkpoint"), RunLog(spark, str(tmp_path / "log"))
    done, compact = [], log.compact
    log.compact = lambda **kw: (done.append(kw), compact(**kw))
    for i in range(9):  # batches of equal size
        rows = [run_event(1000 * i + k, "log", f"run-{i}-{k}", dataset_path=f"{i * 37 + k * 91}") for k in range(50)]
        local_frame(spark, [*rows, run_event(1000 * i + 99, "log", "often")], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    follow_runs(file_stream(spark, folder, "*.parquet", EVENT_SCHEMA, files_per_batch=1), log, checkpoint, 1).awaitTermination()
    assert 1 <= len(done) <= 4  # each time the log has about doubled, not eight times
    assert log.runs().count() == 451


def test_compacting_moves_no_record_while_little_is_superseded(spark):
    events = local_frame(spark, [run_event(1, "log", "a"), run_event(2, "log", "a"), run_event(3, "log", "b"),
                                 run_event(4, "delete", "b"), run_event(5, "log", None), run_event(None, "log", "c"),
                                 run_event(6, "promote", "a")], EVENT_SCHEMA)
    old = local_frame(spark, [tuple(r) for r in superseded(events).collect()], "run_id string, seq bigint")
    assert sorted(tuple(r) for r in old.collect()) == [("a", 1), ("b", 3)]
    for kept in (compacted(events), compacted(events, old)):
        assert sorted((r.seq, r.event) for r in kept.collect()) == [(2, "log"), (4, "delete"), (6, "promote")]
