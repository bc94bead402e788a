"""Event streams: telemetry roll-ups, running stage states, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.sources.files import parse_events


def read_event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Task events from JSON lines as files arrive, with an event time ``ts``."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parse_events(lines).withColumn("ts", F.timestamp_seconds("time"))


def rollup(events: DataFrame, key: str, value: str, ts: str = "ts", width: str = "1 minute", late: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts, mean and extremes per key and window; works on batches and, with a watermark, on streams."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "mean_value", "min_value", "max_value")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions per key: a gap without events ends one."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def monotone_progress(events: DataFrame) -> DataFrame:
    """Progress that never falls back.

    A batch gets the running maximum of every row, by task and ``seq``; a stream (update mode) the largest value so far of
    each task that has new events, which is the same rule seen from the last row.
    """
    if events.isStreaming:
        return events.groupBy("task").agg(F.max("value").alias("progress"), F.max("seq").alias("seq"))
    from pyspark.sql import Window

    w = Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.max("value").over(w))


def stage_stream(events: DataFrame) -> DataFrame:
    """Current status per project and stage from a stream (update or complete mode): the latest by sequence."""
    return events.groupBy("project", "stage").agg(F.max(F.struct("seq", "status")).alias("m")).select("project", "stage", F.col("m.status").alias("status"), F.col("m.seq").alias("seq"))
