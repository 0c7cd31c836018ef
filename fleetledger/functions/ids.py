"""64-bit time-ordered identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the id layout.
EPOCH_MS = 1288834974657
TIME_SHIFT = 22
MACHINE_SHIFT = 12
MACHINES = 1024
SEQUENCES = 4096
DEFAULT_MACHINE = 1


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def id_millis(ts: Column) -> Column:
    """Unix milliseconds of ``ts``, rounded half up from microseconds."""
    return F.unix_millis(F.timestamp_micros(F.unix_micros(ts) + 500))


def machine_slot(machine) -> Column:
    """Machine number in 0..1023; NULL means machine 1."""
    return F.coalesce(F.pmod(_column(machine).cast("long"), F.lit(MACHINES)), F.lit(DEFAULT_MACHINE).cast("long"))


def assemble(ms: Column, slot: Column, seq: Column) -> Column:
    return (
        F.shiftleft(ms - F.lit(EPOCH_MS), TIME_SHIFT)
        .bitwiseOR(F.shiftleft(slot.cast("long"), MACHINE_SHIFT))
        .bitwiseOR(seq.cast("long"))
    )


def snowflake(ts: Column, machine=None, seq=0) -> Column:
    """Identifier for a moment, a machine and a sequence number; one outside 0..4095 is an error, as it would repeat another's."""
    number = _column(seq).cast("long")
    message = F.concat(F.lit("sequence number "), number, F.lit(" is not in 0..4095"))
    inside = F.when(number.between(0, SEQUENCES - 1), number).when(number.isNotNull(), F.raise_error(message).cast("long"))
    return assemble(id_millis(ts), machine_slot(machine), inside)


def snowflake_parts(identifier: Column) -> Column:
    """Struct of ``ts``, ``machine`` and ``seq`` held in an identifier."""
    return F.struct(
        F.timestamp_millis(F.shiftright(identifier, TIME_SHIFT) + F.lit(EPOCH_MS)).alias("ts"),
        F.shiftright(identifier, MACHINE_SHIFT).bitwiseAND(F.lit(MACHINES - 1)).cast("int").alias("machine"),
        identifier.bitwiseAND(F.lit(SEQUENCES - 1)).cast("int").alias("seq"),
    )


def snowflake_floor(ts: Column) -> Column:
    """Smallest identifier of a moment: bounds a time range on the id column itself."""
    return assemble(id_millis(ts), F.lit(0), F.lit(0))


def create_sql_functions(spark: SparkSession) -> None:
    """Make ``snowflake_id(ts, machine, seq)`` available to SQL text of this session; all but ``ts`` may be left out."""
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION snowflake_id(ts TIMESTAMP, machine BIGINT DEFAULT NULL, seq BIGINT DEFAULT 0)
        RETURNS BIGINT
        RETURN shiftleft(unix_millis(timestamp_micros(unix_micros(ts) + 500)) - {EPOCH_MS}, {TIME_SHIFT})
             | shiftleft(coalesce(pmod(machine, {MACHINES}), {DEFAULT_MACHINE}), {MACHINE_SHIFT})
             | CASE WHEN seq BETWEEN 0 AND {SEQUENCES - 1} THEN seq WHEN seq IS NOT NULL
                 THEN CAST(raise_error(concat('sequence number ', seq, ' is not in 0..4095')) AS BIGINT) END
        """
    )
