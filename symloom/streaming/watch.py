"""Change streams: file events become planned batches; the activity log is followed line by line."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.operators.incremental import BURST_WINDOW, normalise_events, threshold

EVENTS = "kind string, path string, at timestamp"
LOG = "ts string, level string, event string, message string, pid long"


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of file events that watchers write to a folder as JSON lines."""
    return spark.readStream.schema(EVENTS).json(folder)


def watch(events: DataFrame, root: str, extensions: Sequence[str], on_batch: Callable[[DataFrame, bool, int], None], checkpoint: str, files: int = 0, ignore: Sequence[str] = (), once: bool = False) -> StreamingQuery:
    """Calls on_batch(paths, burst, batch_id) for each micro-batch: its changed paths once each.

    What arrives while a batch is worked on is in the next one, which is what debouncing is for. A batch is a burst,
    to be answered by a full build, when it has too many paths for the number of files.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        paths = normalise_events(batch, root, extensions, ignore).persist()
        try:
            n = paths.count()
            if n:
                on_batch(paths, n >= threshold(64, files), batch_id)
        finally:
            paths.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def rolling_bursts(events: DataFrame, files: int = 0, delay: str = "10 seconds") -> DataFrame:
    """(start, n, burst): changes in windows of five seconds, late ones within delay counted; an event-time extension."""
    window = F.window("at", f"{int(BURST_WINDOW.total_seconds())} seconds", "1 second")
    counted = events.withWatermark("at", delay).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n", (F.col("n") >= threshold(96, files)).alias("burst"))


def log_lines(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The entries of an activity log (JSON lines); broken lines do not count."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(folder)
    return lines.select(F.from_json("value", LOG).alias("e")).where("e.ts is not null").select("e.*")


def recent_entries(log: DataFrame, n: int) -> DataFrame:
    """The newest n entries of a log."""
    return log.orderBy(F.desc("ts"), F.desc("pid"), "event").limit(n)
