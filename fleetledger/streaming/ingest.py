"""Continuous, resumable ingest of log segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetledger.sources.event_text import stream_events


def ingest_stream(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    every: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Copy events of new segments to a Parquet table partitioned by ``file``.

    Without ``every`` all waiting segments are taken and the query ends, for use
    from a scheduler; with it (``"10 minutes"``) the query stays up.  The
    checkpoint remembers the segments taken, so a restart goes on after them.
    """
    return start_copy(stream_events(spark, folder, max_files), out, checkpoint, every)


def start_copy(events: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    writer = (
        events.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .partitionBy("file")
        .outputMode("append")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
