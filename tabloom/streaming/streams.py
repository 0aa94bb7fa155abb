"""Fitted operators on streams, windowed profiles, and a live run log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import c
from ..operators.drift import DriftReport
from ..plans.runlog import EVENT_SCHEMA, RunLog
from ..session import scratch_path
from .windows import ReferenceProfile


def file_stream(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None,
) -> DataFrame:
    """Files that appear in a folder, as a stream; at most *files_per_batch* in one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(folder)


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """Every step and model transform is a stateless projection, so batch code serves."""
    return model.transform(stream)


def window_profile(
    stream: DataFrame,
    time_col: str,
    category: str,
    value: str,
    window: str = "1 day",
    slide: str | None = None,
    session_gap: str | None = None,
    watermark: str = "1 day",
) -> DataFrame:
    """Rows, nulls and mean of *value* per window and category.

    Tumbling by default, sliding with *slide*, session windows with
    *session_gap*. Per-window state is one small aggregate per category, dropped
    once the watermark has passed. A timestamp without zone is taken as UTC
    session time, which watermarks need.
    """
    if isinstance(stream.schema[time_col].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time_col, c(time_col).cast("timestamp"))
    if session_gap is not None:
        frame: Column = F.session_window(time_col, session_gap)
    else:
        frame = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return (
        stream.withWatermark(time_col, watermark)
        .groupBy(frame.alias("w"), c(category).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(c(value).isNull()).alias("n_null"),
            F.avg(value).alias("mean_value"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category",
                "n", "n_null", "mean_value")
    )


def start_table(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", trigger: dict | None = None,
) -> StreamingQuery:
    """Append a stream to the table under *path*; by default all there is now, then stop.

    *path* and *checkpoint* belong to the caller. A query that was stopped or failed goes on after its last
    micro-batch when it is started with the same two, and readers of *path* see each row once.
    """
    return (
        stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
        .option("path", path).trigger(**(trigger or {"availableNow": True})).start())


def run_to_table(
    stream: DataFrame, fmt: str = "parquet", mode: str = "append", path: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Process everything available into a table and read it back; a second run with the same places goes on.

    Without *path* and *checkpoint* both are fresh folders of the shared one.
    """
    spark = stream.sparkSession
    if (path is None) != (checkpoint is None):
        raise ValueError("give both path and checkpoint, or neither: they only make sense together")
    target = path or scratch_path(spark, "stream")
    start_table(stream, target, checkpoint or scratch_path(spark, "stream-checkpoint"), fmt, mode).awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).load(target)


class EndableStream:
    """A stream that can be told that no more rows come, so that the windows still open are closed.

    ``stream`` is the given one together with the files of *folder*. :meth:`end` puts one row there with a time
    beyond all others and NULL elsewhere: the watermark passes every real window at the next micro-batch, and the
    row's own window never closes.
    """

    LAST = "9999-01-01 00:00:00"

    def __init__(self, stream: DataFrame, time_col: str, folder: str) -> None:
        self.time_col, self.folder, self.schema = time_col, folder, T.StructType(
            [T.StructField(f.name, f.dataType) for f in stream.schema.fields])
        self.spark = stream.sparkSession
        self._rows(False).write.mode("ignore").parquet(folder)
        self.stream = stream.unionByName(file_stream(self.spark, folder, "*.parquet", self.schema))

    def _rows(self, last: bool) -> DataFrame:
        fields = [
            F.lit(self.LAST if f.name == self.time_col else None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return self.spark.range(1 if last else 0).select(*fields)

    def end(self) -> None:
        self._rows(True).coalesce(1).write.mode("append").parquet(self.folder)


def watch_drift(
    stream: DataFrame, profile: ReferenceProfile, handle: Callable[[DriftReport, int], None], checkpoint: str | None = None,
) -> StreamingQuery:
    """Compare every micro-batch with the reference profile and hand over the report."""
    def check(batch: DataFrame, batch_id: int) -> None:
        handle(profile.compare(batch), batch_id)

    return (
        stream.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "drift-checkpoint"))
        .trigger(availableNow=True).start()
    )


def newest_events(events: DataFrame) -> DataFrame:
    """State of a stream of run events: per run its newest log or delete, and the newest promote of all.

    In update mode a micro-batch yields the runs whose newest event it brought. State is one record per run,
    however often a run is logged; an event older than the state, or one that comes again, yields nothing.
    """
    promote = F.col("event") == "promote"
    now = F.unix_millis(F.current_timestamp())  # of the micro-batch: the same when it is repeated
    # the number decides, and of equal events the first to arrive
    newest = F.max(F.struct(*EVENT_SCHEMA.names, (-F.col("arrived")).alias("arrived"))).alias("e")
    state = events.withColumn("arrived", now).groupBy(
        promote.alias("promote"), F.when(~promote, F.col("run_id")).alias("run")).agg(newest, F.max("arrived").alias("touched"))
    return state.filter(-F.col("e.arrived") == F.col("touched")).select("e.*").drop("arrived")


def follow_runs(
    events: DataFrame, log: RunLog, checkpoint: str, compact_every: int = 100, trigger: dict | None = None,
    then: Callable[[RunLog, int], None] | None = None,
) -> StreamingQuery:
    """Keep *log* up to date with a stream of run events: ``log.runs()`` is right after every micro-batch.

    Each micro-batch adds one folder with the newest events of the runs it changed; a repeated one replaces its
    folder. Every *compact_every* batches the log is compacted, leaving out the folder being written, if it has
    grown enough since (:meth:`RunLog.has_grown`), so files stay bounded. *log* and *checkpoint* belong together: a restart with both goes on where it stopped.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"batch-{batch_id:012d}"
        if batch_id and batch_id % compact_every == 0 and log.has_grown(skip=folder):
            log.compact(skip=folder)
        batch.select(*EVENT_SCHEMA.names).write.mode("overwrite").parquet(f"{log.path}/{folder}")
        if then is not None:
            then(log, batch_id)

    return (
        newest_events(events).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
