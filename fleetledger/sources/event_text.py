"""Decoded row-event text, one row per event, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetledger.session import settle

# Fixed values of the text format.
WHOLE_EVENT = r"^[0-9]+\n#[0-9]{6} +[0-9]+:[0-9]{2}:[0-9]{2} +server id +[0-9]+ "
EVENT_MARK = "\n# at "
NUMBERED_NAME = r"\.([0-9]+)(?:\.[A-Za-z0-9]+)?$"


def segment_number(name: Column) -> Column:
    """Numeric suffix of a segment name such as ``bin.000012`` or ``bin.000012.zst``."""
    return F.regexp_extract(name, NUMBERED_NAME, 1).try_cast("long")


def read_events(spark: SparkSession, path: str, recursive: bool = False, rejoin: bool = True) -> DataFrame:
    """Events of all files under ``path``: ``file, file_no, pos, record``.

    Files are cut at the event mark by the reader itself, so one file is read by
    many tasks and no ordering of lines is needed.  Text before the first mark
    is the event at position 0.  When the folder is partitioned by ``file``,
    that value is the file name.  Compacted archives have a reader of their own
    (:func:`fleetledger.operators.archive.read_archive`).

    A line of an event's own text may look like a mark; the pieces such lines make are put back, see
    :func:`rejoined`.  That looks through the files once when this is called; without ``rejoin`` it does not, and
    :func:`~fleetledger.operators.changelog.broken_events` has the pieces.
    """
    reader = spark.read.option("lineSep", EVENT_MARK).option("recursiveFileLookup", str(recursive).lower())
    pieces = reader.text(path)
    return _shape(rejoined(placed(pieces)) if rejoin else _with_file(pieces))


def placed(lines: DataFrame) -> DataFrame:
    """Pieces with the place they were read from: ``file, value, _path, _block``."""
    return _with_file(lines, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))


def rejoined(pieces: DataFrame) -> DataFrame:
    """``file, value`` of pieces (as of :func:`placed`) with every one that has no event header put back to the piece before it.

    The first pass sums every split of a file up: does it begin with an event, how many does it hold, are there broken
    pieces?  Splits that hold some, or stand before one that begins with one, are few, mostly none; only
    those are read again in order.  A prefix scan numbers their events: inside a split by a window, with the count
    of the splits before it carried over, so a file of any size is many tasks.
    """
    told = pieces.withColumn("_n", F.monotonically_increasing_id())
    told = told.withColumn("_whole", F.regexp_replace(F.substring("value", 1, 200), "^# at ", "").rlike(WHOLE_EVENT))
    preamble = (F.col("_block") == 0) & ~F.col("_first")
    splits = told.groupBy("_path", "_block").agg(F.min_by("_whole", "_n").alias("_first"), F.count_if(~F.col("_whole")).alias("_broken"), F.count_if("_whole").alias("_events"))
    splits = splits.withColumn("_broken", F.col("_broken") - preamble.cast("int")).withColumn("_first", F.col("_first") | (F.col("_block") == 0))
    of_file = Window.partitionBy("_path").orderBy("_block")  # a row for each split of a file
    before = F.coalesce(F.sum("_events").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = splits.withColumns({"_after": F.lead("_first").over(of_file), "_before": before})
    hit = settle(seen.where((F.col("_broken") > 0) | ~F.coalesce("_after", F.lit(True))).select("_path", "_block", "_before"))
    if not hit.limit(1).count():
        return told.select("file", "value")
    in_split = Window.partitionBy("_path", "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    grouped = told.join(hit, ["_path", "_block"]).withColumn("_event", F.col("_before") + F.sum(F.col("_whole").cast("int")).over(in_split))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_n", "value")))
    joined = grouped.groupBy("_path", "_event").agg(F.first("file").alias("file"), parts.alias("_parts"))
    whole = joined.select("file", F.array_join(F.col("_parts")["value"], EVENT_MARK).alias("value"))
    return told.join(hit, ["_path", "_block"], "left_anti").select("file", "value").unionAll(whole)


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming form of :func:`read_events`; pieces of events are not put back, :func:`fleetledger.streaming.events.start_events` does that."""
    reader = spark.readStream.option("lineSep", EVENT_MARK)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _shape(_with_file(reader.text(path)))


def events_from(records: DataFrame) -> DataFrame:
    """Shape raw pieces (``file``, ``value``) cut at the event mark elsewhere."""
    return _shape(records)


def _with_file(lines: DataFrame, *more: Column) -> DataFrame:
    name = F.col("file").cast("string") if "file" in lines.columns else F.col("_metadata.file_name")
    return lines.select(name.alias("file"), "value", *more)


def _shape(pieces: DataFrame) -> DataFrame:
    value = F.col("value")
    body = F.when(value.startswith("# at "), F.substring(value, 6, 1 << 30)).otherwise(value)
    first = F.substring_index(F.col("record"), "\n", 1)
    return pieces.select("file", segment_number(F.col("file")).alias("file_no"), body.alias("record")).select(
        "file",
        "file_no",
        F.when(first.rlike("^[0-9]+$"), first.cast("long")).otherwise(F.lit(0).cast("long")).alias("pos"),
        "record",
    )
