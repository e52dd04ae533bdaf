"""Structured streaming: annotations folded and turns merged as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest_labels(events: DataFrame, key: str, kind: str, value: str, at: str) -> DataFrame:
    """Running latest value of each (key, kind): state is one row each."""
    return events.groupBy(key, kind).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def sessions(events: DataFrame, key: str, at: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with gaps below ``gap``, closed once the watermark passes."""
    marked = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    return marked.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(frame: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Everything that is there, into an in-memory table of that name."""
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
