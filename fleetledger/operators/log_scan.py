"""What stood last before each event of a log: a prefix scan over slices of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.operators.names import free_name

#: Bytes of log in a slice: positions are byte offsets, so slices are even and need no sampling.
SLICE = 1 << 26


def last_before(events: DataFrame, value: Column, name: str, order: tuple[str, ...] = ("pos",), slice_bytes: int | None = None) -> DataFrame:
    """Add the last ``value`` that is not NULL among the earlier events of the same file, in ``order`` (``pos`` first).

    A window over a file would sort it in one task.  Here every slice of a file is summed up by its last value, the
    last values before each slice are carried over (a row for each slice), and a second pass looks inside
    the slices only.  The events are shuffled once, by file and slice; NULL files form a file of their own.
    """
    cut, own, file, part, carry = (free_name(events, x) for x in ("_slice", "_own", "_file", "_part", "_carry"))
    sliced = events.withColumn(own, value).withColumn(cut, F.floor(F.col("pos") / (slice_bytes or SLICE)))
    inside = Window.partitionBy("file", cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(file).orderBy(F.col(part).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by(F.when(F.col(own).isNotNull(), F.col(own)), F.when(F.col(own).isNotNull(), F.struct(*order)))
    slices = sliced.groupBy(F.col("file").alias(file), F.col(cut).alias(part)).agg(newest.alias(own))
    carried = slices.select(file, part, F.last(own, ignorenulls=True).over(earlier).alias(carry))
    same = F.col("file").eqNullSafe(F.col(file)) & F.col(cut).eqNullSafe(F.col(part))
    seen = sliced.join(carried, same, "left").withColumn(name, F.coalesce(F.last(own, ignorenulls=True).over(inside), F.col(carry)))
    return seen.select(*events.columns, name)
