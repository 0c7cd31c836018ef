"""Is a log whole?  Events and segments that are missing or stand twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.operators.changelog import parse_headers
from fleetledger.operators.log_scan import last_before

#: Position of the first event of a segment, and kinds of events that end one (fixed values of the log format).
FIRST = 4
LAST_KINDS = ("Rotate", "Stop")
#: What is reported: the begin of a segment, events inside it, events read twice, its end, whole segments.
HEAD, GAP, OVERLAP, TAIL, SEGMENTS = "head", "gap", "overlap", "tail", "segments"


def log_gaps(events: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """``file, file_no, kind, from_pos, to_pos``: what is missing between the events of a log.

    Every event tells where it ends, and there the next one begins.  Inside a segment each event is compared with
    the one before it, by slices (:func:`~fleetledger.operators.log_scan.last_before`), so a segment of any size is many tasks.
    Only one row for each segment goes on to be compared with the segment before it: for ``segments`` the two positions are the
    first and the last number that is missing, beside the segment that follows.  The newest segment needs no end.
    Events without an end position (their header is broken) are told as the gap they leave.
    """
    heads = parse_headers(events.where("pos > 0")).select("file", "file_no", "pos", "end_pos", "kind")
    beside = last_before(heads, F.when(F.col("end_pos").isNotNull(), F.struct("end_pos")), "_before", slice_bytes=slice_bytes)
    before = F.col("_before")["end_pos"]
    inside = beside.where(before.isNotNull() & (before != F.col("pos")))
    kind = F.when(before < F.col("pos"), GAP).otherwise(OVERLAP)
    found = inside.select("file", "file_no", kind.alias("kind"), before.alias("from_pos"), F.col("pos").alias("to_pos"))

    last = F.max_by(F.struct("end_pos", "kind"), "pos")
    segments = heads.groupBy("file", "file_no").agg(F.min("pos").alias("_first"), last.alias("_last"))
    # A row for each segment; those of one series of files stand in one window.
    series = F.regexp_replace("file", r"[0-9]+(?:\.[A-Za-z0-9]+)?$", "")
    in_order = Window.partitionBy("_series").orderBy("file_no", "file")
    ranked = segments.withColumn("_series", series).withColumns({"_number": F.lag("file_no").over(in_order), "_newest": F.lead("file").over(in_order).isNull()})

    def told(kind: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.cast("long").alias("from_pos"), high.cast("long").alias("to_pos"))

    nothing = F.lit(None)
    of_segment = F.array_compact(
        F.array(
            F.when(F.col("_first") > FIRST, told(HEAD, F.lit(FIRST), F.col("_first"))),
            F.when(~F.col("_newest") & ~F.coalesce(F.col("_last.kind").isin(*LAST_KINDS), F.lit(False)), told(TAIL, F.col("_last.end_pos"), nothing)),
            F.when(F.col("file_no") > F.col("_number") + 1, told(SEGMENTS, F.col("_number") + 1, F.col("file_no") - 1)),
        )
    )
    return found.unionByName(ranked.select("file", "file_no", F.explode(of_segment).alias("g")).select("file", "file_no", "g.*"))
