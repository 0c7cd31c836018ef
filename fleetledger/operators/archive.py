"""Retention, resume point and compaction of log segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.functions.clock import is_past_days

# Name endings of segments that are already compressed.
COMPRESSED_SUFFIXES = (".xz", ".zst", ".gz")


def is_compressed(name: Column) -> Column:
    return F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in COMPRESSED_SUFFIXES) + ")$")


def last_segment(segments: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Where to resume each source: its newest segment, else the source's current one.

    ``fallback`` has ``source`` and ``name`` (what the source itself reports).
    """
    newest = segments.groupBy("source").agg(F.max_by("name", F.struct("seq", "name")).alias("name"))
    if fallback is None:
        return newest
    current = fallback.groupBy("source").agg(F.max("name").alias("_current"))
    return newest.join(current, "source", "full_outer").select("source", F.coalesce("name", "_current").alias("name"))


def expired(segments: DataFrame, days: int, now, prefix: str = "") -> DataFrame:
    """Segments to remove: name starts with ``prefix`` and more than ``days`` whole days old."""
    return segments.where(F.col("name").startswith(prefix) & is_past_days(F.col("mtime"), now, days))


def retain(segments: DataFrame, days: int, now, prefix: str = "") -> DataFrame:
    """Segments that stay."""
    gone = F.col("name").startswith(prefix) & is_past_days(F.col("mtime"), now, days)
    return segments.where(~F.coalesce(gone, F.lit(False)))


def finished(segments: DataFrame, prefix: str = "") -> DataFrame:
    """Segments to compact: not compressed yet, and not the newest of their source.

    "Newest" is among the uncompressed ones.  The newest number per source is an
    aggregate joined back, so a source with very many segments is not sorted in
    one task.
    """
    plain = segments.where(F.col("name").startswith(prefix) & ~is_compressed(F.col("name")))
    newest = plain.groupBy("source").agg(F.max(F.struct("seq", "name")).alias("_newest"))
    return plain.join(newest, "source").where(F.struct("seq", "name") != F.col("_newest")).select(*segments.columns)


def compact(events: DataFrame, segments: DataFrame, path: str, prefix: str = "", archived: DataFrame | None = None) -> None:
    """Rewrite the events of finished segments as a compressed columnar archive, without those in ``archived`` (source, name).

    ``events`` has ``source, file, file_no, pos, record``; layout ``source=…/file=…`` lets
    later reads prune to the segments they need.  The list of finished segments
    joins by its measured size: while it is short, each task writes what it read and
    the content is not shuffled.
    """
    done = finished(segments, prefix)
    if archived is not None:
        done = done.join(archived.select("source", "name"), ["source", "name"], "left_anti")
    done = done.select("source", F.col("name").alias("file"))
    (
        events.join(done, ["source", "file"], "left_semi")
        .select("source", "file", "file_no", "pos", "record")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "file")
        .parquet(path)
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Events of an archive, as the reader of event text gives them, with their ``source``."""
    kept = spark.read.schema("file_no long, pos long, record string, source string, file string").parquet(path)
    return kept.select("source", "file", "file_no", "pos", "record")


def archived_segments(spark: SparkSession, path: str) -> DataFrame:
    """``source, name`` of the segments in an archive, from the names of its folders."""
    return read_archive(spark, path).select("source", F.col("file").alias("name")).distinct()
