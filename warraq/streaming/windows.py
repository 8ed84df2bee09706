"""Streaming forms: windowed sums, sessions, duplicates within the watermark.

Counts are sums, so the streaming and the batch form share their expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """A parquet folder as a stream with the schema of a batch table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, ts: str, length: str, by: str, late: str | None = None) -> DataFrame:
    """Count and sum of each window and key; `late` sets the watermark on a stream."""
    x = events.withWatermark(ts, late) if late else events
    return x.groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, ts: str, length: str, slide: str, by: str, late: str | None = None) -> DataFrame:
    x = events.withWatermark(ts, late) if late else events
    return x.groupBy(F.window(ts, length, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    x = events.withWatermark(ts, late) if late else events
    return x.groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Drops repeats of a key that arrive within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result as a table (tests)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
