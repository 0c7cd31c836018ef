"""Events grouped by transaction, and the unfinished ones held back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.operators.changelog import STATEMENT
from fleetledger.operators.log_scan import last_before
from fleetledger.operators.names import free_name

# Fixed values of the text format: a statement begins after a comment line or the end of another one.
BOUNDARY = r"(?m)(?:^#[^\n]*|;)\n(BEGIN|START TRANSACTION|COMMIT|ROLLBACK) *\n?/\*!\*/;"
OPENS = ("BEGIN", "START TRANSACTION")
COMMITTED, ROLLED_BACK, UNFINISHED = "committed", "rolled back", "unfinished"


def boundary(record: Column) -> Column:
    """The first statement of an event that begins or ends a transaction, else NULL."""
    likely = F.lit(False)
    for word in ("BEGIN", "START TRANSACTION", "COMMIT", "ROLLBACK"):
        likely = likely | record.contains(word)
    return F.when(likely, F.nullif(F.regexp_extract(record, BOUNDARY, 1), F.lit("")))


def with_transactions(events: DataFrame, name: str = "begin_pos", slice_bytes: int | None = None) -> DataFrame:
    """Add the position of the event that began each event's transaction; NULL outside transactions.

    A transaction lies in one file.  The event that ends it belongs to it.  Where a transaction begins before the last
    one has ended (a log that was cut), the last one ends there, unfinished.
    """
    own, before = free_name(events, "_boundary"), free_name(events, "_before")
    marked = events.withColumn(own, boundary(F.col("record")))
    opens = F.col(own).isin(*OPENS)
    # A NULL boundary is no value; an end is one, without a position.
    last = F.when(F.col(own).isNotNull(), F.struct(F.when(opens, F.col("pos")).alias("begin")))
    seen = last_before(marked, last, before, slice_bytes=slice_bytes)
    return seen.select(*events.columns, F.when(F.coalesce(opens, F.lit(False)), F.col("pos")).otherwise(F.col(before)["begin"]).alias(name))


def transactions(events: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """``file, file_no, begin_pos, end_pos`` (its last event), ``n_events, n_rows`` (row statements) and ``outcome`` of every transaction."""
    found = with_transactions(events, slice_bytes=slice_bytes).where("begin_pos is not null")
    rows = F.when(F.col("record").contains("\n### "), F.size(F.split("record", STATEMENT)) - 1).otherwise(0)
    end = F.max(F.when(F.col("pos") > F.col("begin_pos"), boundary(F.col("record"))))
    outcome = F.when(end == "COMMIT", COMMITTED).when(end == "ROLLBACK", ROLLED_BACK).otherwise(UNFINISHED)
    return found.groupBy("file", "file_no", "begin_pos").agg(
        F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("n_events"), F.sum(rows).cast("long").alias("n_rows"), outcome.alias("outcome")
    )


def _of_transactions(events: DataFrame, which: Column, how: str, slice_bytes: int | None) -> DataFrame:
    name = free_name(events, "begin_pos")
    # Few transactions are not committed; those alone are looked up.
    sought = transactions(events, slice_bytes).where(which).select(F.col("file").alias("_file"), F.col("begin_pos").alias("_begin"))
    same = F.col("file").eqNullSafe(F.col("_file")) & (F.col(name) == F.col("_begin"))
    return with_transactions(events, name, slice_bytes).join(sought, same, how).select(*events.columns)


def finished(events: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """Events that took effect: outside transactions, or in committed ones.  The rest is :func:`held_back` or was rolled back."""
    return _of_transactions(events, F.col("outcome") != COMMITTED, "left_anti", slice_bytes)


def held_back(events: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """Events of transactions whose end the log does not have (yet)."""
    return _of_transactions(events, F.col("outcome") == UNFINISHED, "left_semi", slice_bytes)
