"""Incremental acquisition as file streams: progress lies in the checkpoint, rows seen once stay out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def new_lines(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Records appended to a folder of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str, event_time: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Appends records of new keys to a table and ends when the folder is read.

    With an event time the state forgets keys older than the delay; without one it keeps every key.
    """
    fresh = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else stream.dropDuplicates([key])
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets whose key is not among those done."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each batch of new files to ``handle``; once over the folder, or every so often."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def hourly(stream: DataFrame, time: str, kind: str, value: str, delay: str = "2 hours") -> DataFrame:
    """An extension: events by hour and kind; late ones count until the delay is over."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", kind, "n", "total")
