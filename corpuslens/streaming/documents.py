"""Structured Streaming over arriving documents and events (an extension: the batch operators are reused as they are)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as K


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def scored(stream: DataFrame) -> DataFrame:
    """Dimension scores of each arriving document: stateless."""
    return K.dimension_scores(stream)


def _timed(events: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need a timestamp with the session's time zone."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, *, time_col: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped, and its state is freed."""
    return _timed(events, time_col).withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, time_col: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return _timed(events, time_col).withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), by).agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each micro-batch through a batch transform into a folder of its own, so that a repeated batch overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
