"""Incremental ingestion and event-time windows with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watched_files(spark: SparkSession, folder: str, pattern: str = "*.{md,json}") -> DataFrame:
    """New and changed files below a folder as a stream: path, content, modificationTime, length.

    Deletions are no events; a listing shows them (``maintenance.vanished``).
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def on_changes(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ``ingest(files, batch)`` once for the files that came since the last run: at each interval, or once over what there is.

    A path that comes twice in a batch is given once, with its newest content. The checkpoint
    makes a lost driver go on where it was; ``ingest`` must give the same result if repeated.
    """

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content", "modificationTime", "length"), "modificationTime").alias("f")).select("path", "f.*")
        ingest(newest, number)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _on_time(rows: DataFrame, late: str) -> DataFrame:
    """A stream's rows that are not too late; times without a zone are taken in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def debounced(changes: DataFrame, gap: str, late: str = "1 minute") -> DataFrame:
    """(source, started, ended, paths) of bursts of changes (ts, source, path) between which nothing happened for a while."""
    rows = _on_time(changes, late)
    return rows.groupBy(F.session_window("ts", gap), "source").agg(F.array_sort(F.collect_set("path")).alias("paths")).select("source", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "paths")


def windowed(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """(started, event_type, n, total) of events (ts, event_type, value) in windows of a width; later ones than ``late`` are dropped from a stream."""
    rows = _on_time(events, late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")


class Remembered:
    """What a function gave for a key, for a time; then it is asked again."""

    def __init__(self, make: Callable[[str], object], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self.held: dict[str, tuple[float, object]] = {}

    def get(self, key: str) -> object:
        """The value of a key, made where it is missing or too old."""
        now = self.clock()
        if key not in self.held or now - self.held[key][0] >= self.seconds:
            self.held[key] = (now, self.make(key))
        return self.held[key][1]


class Current:
    """A table that readers share, swapped as a whole."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.cache()

    def swap(self, rows: DataFrame) -> None:
        """Loads the new rows before the old ones go."""
        fresh = rows.cache()
        fresh.count()
        old, self.rows = self.rows, fresh
        old.unpersist()
