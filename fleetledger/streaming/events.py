"""Events of log files as they arrive, with pieces put back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetledger.sources.event_text import EVENT_MARK, events_from, placed, rejoined


def start_events(spark: SparkSession, path: str, target: str, checkpoint: str, max_files: int | None = None, every: str | None = None) -> StreamingQuery:
    """Start writing the events of all files that arrive under ``path`` below ``target``, a folder for each micro-batch.

    The file source hands a file on once, whole, in one micro-batch; so what :func:`rejoined` needs of a file, its splits and
    their order, is all there, and no piece waits for a later batch.  Files must be put in place whole (finished segments).
    A batch that is run again after a failure overwrites its own folder.
    """
    reader = spark.readStream.option("lineSep", EVENT_MARK)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, number: int) -> None:
        events_from(rejoined(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = placed(reader.text(path)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def written_events(spark: SparkSession, target: str) -> DataFrame:
    """The events of all finished micro-batches."""
    return spark.read.parquet(target).drop("batch")
