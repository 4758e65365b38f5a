"""Streams: sessions by gap, ingestion that resumes from its checkpoint, dropping of late repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; the query's checkpoint takes the place of a log of what is done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(events: DataFrame, by: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Per key the runs of events with gaps under ``gap``: start, end, number and sum. On a stream, rows later than ``late`` are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return found.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def windows(events: DataFrame, length: str, slide: str | None = None, by: str = "event_type", time: str = "ts", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Tumbling or sliding windows per key."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(by, F.window(time, length, slide).alias("w")).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return found.select(by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "total")


def without_repeats(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key; on a stream, keys are remembered for ``late``."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Write all there is and stop; called again, it goes on after what is done."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
