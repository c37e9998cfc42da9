"""Chunking is per file, so a stream of files is chunked by the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk_files import text_chunks


def stream_text_chunks(files: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Text chunks of a stream of ``files(path, text, ts)``; a chunk id comes once within the watermark."""
    return text_chunks(files.withWatermark(at, delay)).dropDuplicatesWithinWatermark(["chunk_id"])


def event_counts(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their values by type in tumbling windows of event time."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is available now, to Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
