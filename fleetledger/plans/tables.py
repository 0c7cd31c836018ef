"""Supplied tables, read with only the columns a query names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table; zone-less timestamps are read as of the session's zone, UTC in sessions of this library."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    chosen = columns or df.columns
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kinds[c] == "timestamp_ntz" else F.col(c) for c in chosen])


def seconds(column: str):
    """A timestamp column as whole seconds."""
    return F.unix_timestamp(F.col(column))
