"""Schema dumps: which column stands at which ordinal of which table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.functions.literals import unquote_name

# Fixed values of the dump format.
DATABASE_MARK = "\nUSE "
_DATABASE = r"^(?:USE )?(?:`((?:[^`]|``)+)`|([^`;\s]+))\s*;"
_TABLE = r"(?ms)^CREATE TABLE (?:IF NOT EXISTS )?`((?:[^`]|``)+)` \($(.*?)^\) ENGINE="
_COLUMN = r"^  `((?:[^`]|``)+)`"


def read_ddl(spark: SparkSession, path: str) -> DataFrame:
    """One row (``section``) per database of the dump."""
    return spark.read.option("lineSep", DATABASE_MARK).text(path).select(F.col("value").alias("section"))


def schema_catalog(sections: DataFrame) -> DataFrame:
    """``db, table, ordinal, column`` of every table in the dump; key lines are not columns."""
    section = F.col("section")
    db = F.coalesce(
        F.nullif(F.regexp_extract(section, _DATABASE, 1), F.lit("")), F.regexp_extract(section, _DATABASE, 2)
    )
    tables = F.arrays_zip(
        F.regexp_extract_all(section, F.lit(_TABLE), 1).alias("name"),
        F.regexp_extract_all(section, F.lit(_TABLE), 2).alias("body"),
    )
    lines = F.filter(F.split(F.col("t.body"), "\n"), lambda line: line.startswith("  `"))
    return (
        sections.select(unquote_name(db).alias("db"), F.explode(tables).alias("t"))
        .select("db", unquote_name(F.col("t.name")).alias("table"), F.posexplode(lines).alias("at", "line"))
        .select(
            "db",
            "table",
            (F.col("at") + 1).alias("ordinal"),
            unquote_name(F.regexp_extract("line", _COLUMN, 1)).alias("column"),
        )
    )
