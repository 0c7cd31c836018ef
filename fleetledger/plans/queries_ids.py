"""Registered queries on identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.functions.ids import snowflake, snowflake_floor, snowflake_parts
from fleetledger.operators.ids import with_bulk_snowflake_id, with_snowflake_id
from fleetledger.plans.tables import table
from fleetledger.session import shared_folder
from fleetledger.streaming.ids import start_bulk_ids


def _orders(spark, folder) -> DataFrame:
    # 20 years on, past the id epoch; 512 neighbouring orders share a millisecond of their day.
    millis = F.unix_millis("o_orderdate") + F.lit(7305 * 86400000) + F.shiftright("o_orderkey", 9) % 86400000
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", (F.col("o_custkey") % 8).alias("machine"), F.timestamp_millis(millis).alias("ts")
    )


def ids_event_time(spark, folder) -> DataFrame:
    ids = with_snowflake_id(_orders(spark, folder), F.col("ts"), F.col("machine"), [F.col("o_orderkey")])
    return ids.select("o_orderkey", "id")


def _event_ids(spark, folder) -> DataFrame:
    machine = F.nullif(F.col("user_id") - 5, F.lit(0))
    return table(spark, folder, "events", "event_id", "ts", "user_id").select(
        "event_id", "ts", snowflake(F.col("ts"), machine, F.col("event_id") % 4096).alias("id")
    )


def ids_compose(spark, folder) -> DataFrame:
    return _event_ids(spark, folder).select("event_id", "id")


def ids_decode(spark, folder) -> DataFrame:
    parts = snowflake_parts(F.col("id")).alias("p")
    return _event_ids(spark, folder).select("event_id", parts).select(
        "event_id", F.unix_millis("p.ts").alias("ms"), F.col("p.machine").cast("long").alias("machine"), F.col("p.seq").cast("long").alias("seq")
    )


def ids_time_range(spark, folder) -> DataFrame:
    day = [F.lit(d).cast("timestamp") for d in ("2024-01-10", "2024-01-12")]
    ids = _event_ids(spark, folder)
    inside = ids.where((F.col("id") >= snowflake_floor(day[0])) & (F.col("id") < snowflake_floor(day[1])))
    return inside.select("event_id", "id")


def ids_bulk_count(spark, folder) -> DataFrame:
    ids = with_bulk_snowflake_id(table(spark, folder, "lineitem", "l_orderkey"), 1700000000000)
    return ids.agg(F.count("id").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def ids_bulk_stream(spark, folder) -> DataFrame:
    """Lines of orders numbered by a stream of four files in two starts; how many rows have the identifier of each."""
    source, target, mark = (shared_folder(spark, p) for p in ("lines", "numbered", "mark"))
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber")
    for half in (0, 1):
        lines.where(F.col("l_orderkey") % 2 == half).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_bulk_ids(stream, target, mark, 1700000000000).awaitTermination()
    same = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return spark.read.parquet(target).select("l_orderkey", "l_linenumber", same.alias("n_same"))


_COMPOSED = """
WITH parts AS (
  SELECT event_id, (epoch_us(ts) + 500) // 1000 AS ms,
         coalesce(((nullif(user_id - 5, 0) % 1024) + 1024) % 1024, 1) AS machine, event_id % 4096 AS seq
  FROM events),
ids AS (SELECT *, (ms - 1288834974657) * 4194304 + machine * 4096 + seq AS id FROM parts)
"""

QUERIES = {
    "ids_event_time": (
        ids_event_time,
        """
        WITH o AS (
          SELECT o_orderkey, o_custkey % 8 AS machine,
                 epoch_ms(o_orderdate) + 7305 * 86400000::BIGINT + (o_orderkey // 512) % 86400000 AS ms
          FROM orders)
        SELECT o_orderkey,
               (ms - 1288834974657) * 4194304 + machine * 4096
               + row_number() OVER (PARTITION BY machine, ms ORDER BY o_orderkey) - 1 AS id
        FROM o""",
    ),
    "ids_compose": (ids_compose, _COMPOSED + "SELECT event_id, id FROM ids"),
    "ids_decode": (
        ids_decode,
        _COMPOSED + "SELECT event_id, (id >> 22) + 1288834974657 AS ms, (id >> 12) & 1023 AS machine, id & 4095 AS seq FROM ids",
    ),
    "ids_time_range": (
        ids_time_range,
        _COMPOSED
        + "SELECT event_id, id FROM ids WHERE ms >= epoch_ms(TIMESTAMP '2024-01-10') AND ms < epoch_ms(TIMESTAMP '2024-01-12')",
    ),
    "ids_bulk_stream": (ids_bulk_stream, "SELECT l_orderkey, l_linenumber, 1 AS n_same FROM lineitem"),
    "ids_bulk_count": (ids_bulk_count, "SELECT count(*) AS n_rows, count(*) AS n_ids FROM lineitem"),
}
