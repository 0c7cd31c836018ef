"""Identifier columns for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.functions.ids import SEQUENCES, MACHINES, assemble, id_millis, machine_slot
from fleetledger.operators.names import free_name

# monotonically_increasing_id() keeps the partition above bit 33; 2^33 rows at
# 4096 a millisecond fill 2^21 milliseconds.
_ROW_BITS = 33
PARTITION_STRIDE_MS = 1 << 21


def with_snowflake_id(df: DataFrame, ts: Column, machine, order: list[Column], name: str = "id") -> DataFrame:
    """Event-time identifiers: the sequence restarts for each machine and millisecond.

    A millisecond of one machine holds 4096 identifiers; one more row is an error,
    whether or not the identifier is read: the filter on the number of a row cannot be
    pruned, and it keeps every row.
    """
    ms, slot, n = (free_name(df, x) for x in ("_ms", "_slot", "_n"))
    slots = df.withColumn(ms, id_millis(ts)).withColumn(slot, machine_slot(machine))
    numbered = slots.withColumn(n, F.row_number().over(Window.partitionBy(slot, ms).orderBy(*order)))
    message = F.concat(F.lit("more than 4096 rows for machine "), F.col(slot), F.lit(" at ms "), F.col(ms))
    fits = F.when(F.col(n) > SEQUENCES, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return numbered.where(fits).withColumn(name, assemble(F.col(ms), F.col(slot), F.col(n) - 1)).drop(*{ms, slot, n} - {name})


def with_bulk_snowflake_id(df: DataFrame, base_ms: int, name: str = "id") -> DataFrame:
    """Identifiers for a large write without a shuffle.

    Values depend on the partitioning: write the result before using it twice.
    """
    mono = F.monotonically_increasing_id()
    own = free_name(df, "_mono")
    rows = df.withColumn(own, mono)
    part = F.shiftright(F.col(own), _ROW_BITS)
    row = F.col(own).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ms = F.lit(base_ms) + F.shiftright(row, 12) + F.shiftright(part, 10) * F.lit(PARTITION_STRIDE_MS)
    return rows.withColumn(
        name, assemble(ms, part.bitwiseAND(F.lit(MACHINES - 1)), row.bitwiseAND(F.lit(SEQUENCES - 1)))
    ).drop(*{own} - {name})
