"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.operators.names import free_name
from fleetledger.session import settle


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
    slice_by: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, in ``order``.

    A plain window would sort a whole group in one task.  Here a group is cut
    into slices that follow ``order``; rows are numbered inside their slice and
    shifted by the row counts of the slices before it.

    ``slice_by`` must never decrease along ``order`` (for example the hour of the
    first ordering time).  Without it the rows are range partitioned, which cuts
    large groups evenly, and stored once so that both uses see the same slices.
    NULL keys form groups of their own, and a NULL slice comes first.
    """
    cut, inner, rows, shift, part = (free_name(df, x) for x in ("_slice", "_inside", "_rows", "_shift", "_part"))
    held = [free_name(df, f"_key{i}") for i in range(len(keys))]
    if slice_by is None:
        count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
        sliced = settle(ranged.withColumn(cut, F.spark_partition_id()))
    else:
        sliced = df.withColumn(cut, slice_by)
    by_slice = Window.partitionBy(*keys).orderBy(F.col(cut).asc_nulls_first())
    shifts = (
        sliced.groupBy(*keys, cut)
        .agg(F.count(F.lit(1)).alias(rows))
        .withColumn(
            shift,
            F.coalesce(F.sum(rows).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(*[F.col(k).alias(held[i]) for i, k in enumerate(keys)], F.col(cut).alias(part), shift)
    )
    same = [F.col(k).eqNullSafe(F.col(held[i])) for i, k in enumerate(keys)] + [F.col(cut).eqNullSafe(F.col(part))]
    inside = F.row_number().over(Window.partitionBy(*keys, cut).orderBy(*order))
    return (
        sliced.withColumn(inner, inside)
        .join(shifts, same)
        .withColumn(name, F.col(inner).cast("long") + F.col(shift))
        .select(*df.columns, name)
    )
