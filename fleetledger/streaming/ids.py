"""Bulk identifiers for the rows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetledger.functions.ids import MACHINES, SEQUENCES
from fleetledger.operators.ids import PARTITION_STRIDE_MS, with_bulk_snowflake_id

_RANGE = "base_ms long, end_ms long, batch long"


def _needed_ms(batch: DataFrame) -> int:
    """Milliseconds that :func:`with_bulk_snowflake_id` uses for a batch, from the sizes of its partitions."""
    sizes = batch.groupBy(F.spark_partition_id().alias("p")).count()
    own = F.floor((F.col("count") - 1) / SEQUENCES) + 1 + F.floor(F.col("p") / MACHINES) * PARTITION_STRIDE_MS
    return sizes.agg(F.coalesce(F.max(own), F.lit(0))).first()[0]


def start_bulk_ids(stream: DataFrame, target: str, checkpoint: str, base_ms: int, name: str = "id", every: str | None = None) -> StreamingQuery:
    """Start writing ``stream`` with identifiers below ``target``, a folder for each micro-batch.

    Every batch reserves a range of milliseconds, behind those of all batches before it, in a log beside the checkpoint, before it
    writes.  A batch that is run again finds its reservation, begins at the same millisecond and overwrites its own folder; it
    is the newest, so its end may move.  Identifiers are unique over all batches and rise from batch to batch.  One stream owns
    all machine numbers of its milliseconds, as with :func:`with_bulk_snowflake_id`.
    """
    spark, log = stream.sparkSession, f"{checkpoint.rstrip('/')}-ranges"
    # An entry that stands before all batches, so that the log can always be read.
    _reserve(spark, log, -1, base_ms, base_ms, "ignore")

    def write(batch: DataFrame, number: int) -> None:
        ranges = _ranges(spark, log)
        own, before = ranges.where(F.col("batch") == number), ranges.where(F.col("batch") < number)
        begin = own.agg(F.coalesce(F.max("base_ms"), before.agg(F.max("end_ms")).scalar())).first()[0]
        _reserve(spark, log, number, begin, begin + _needed_ms(batch), "overwrite")
        with_bulk_snowflake_id(batch, begin, name).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _ranges(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(_RANGE).parquet(log)


def _reserve(spark: SparkSession, log: str, number: int, begin: int, end: int, mode: str) -> None:
    row = spark.createDataFrame([(begin, end)], "base_ms long, end_ms long")
    row.coalesce(1).write.mode(mode).parquet(f"{log}/batch={number}")
