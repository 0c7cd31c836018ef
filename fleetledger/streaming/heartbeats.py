"""Silent hosts: sessions of heartbeats that ended by a gap longer than the timeout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.functions.clock import instant

# Fixed value: three check intervals of one minute, less a second.
TIMEOUT = 179


def heartbeat_gaps(
    beats: DataFrame,
    timeout: int = TIMEOUT,
    keys: tuple[str, ...] = ("connectionName", "host"),
    ts: str = "ts",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Sessions per key: ``started``, ``last_beat``, ``silent_from`` and ``beats``.

    Two beats belong together when they are at most ``timeout`` whole seconds
    apart.  On a stream a session comes out once the watermark has passed
    ``silent_from``.  On a table the beats are counted per second and cut into days, so one key is worked on by
    as many tasks as it has days; only sessions that may go on over midnight, two a day at most for a timeout
    below a day, are put together per key.
    """
    second = beats.withColumn("_at", F.date_trunc("second", F.col(ts)))
    session = F.session_window("_at", f"{timeout} seconds").alias("session")
    found = [F.min("_at").alias("started"), F.max("_at").alias("last_beat")]
    if beats.isStreaming:
        late = second.withWatermark("_at", lateness).groupBy(*keys, session).agg(*found, F.count(F.lit(1)).alias("beats"))
        return late.select(*keys, "started", "last_beat", F.col("session.end").alias("silent_from"), "beats")
    counted = second.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_beats")).withColumn("_day", F.date_trunc("day", "_at"))
    daily = counted.groupBy(*keys, "_day", session).agg(*found, F.sum("_beats").alias("beats")).drop("session")
    begin, end = F.unix_timestamp("started"), F.unix_timestamp("last_beat")
    midnight = F.unix_timestamp("_day")
    at_border = (begin - midnight <= timeout) | (midnight + 86400 - end <= timeout)
    daily = daily.withColumn("_border", at_border)
    in_order = Window.partitionBy(*keys).orderBy("started")
    starts = F.coalesce(begin - F.lag(end).over(in_order) > timeout, F.lit(True)).cast("int")
    linked = daily.where("_border").withColumn("_starts", starts).withColumn("_part", F.sum("_starts").over(in_order))
    merged = linked.groupBy(*keys, "_part").agg(F.min("started").alias("started"), F.max("last_beat").alias("last_beat"), F.sum("beats").alias("beats"))
    every = daily.where("not _border").select(*keys, "started", "last_beat", "beats").unionByName(merged.drop("_part"))
    silent = F.timestamp_seconds(end + timeout).alias("silent_from")
    return every.select(*keys, "started", "last_beat", silent, "beats")


def silent_now(beats: DataFrame, now, timeout: int = TIMEOUT, keys: tuple[str, ...] = ("connectionName", "host"), ts: str = "ts") -> DataFrame:
    """Keys whose newest beat is older than ``timeout`` at ``now``.

    Needs no later beat of anybody, so it also sees a fleet that is silent as a whole.
    """
    age = F.unix_timestamp(instant(now)) - F.unix_timestamp("last_beat")
    return (
        beats.groupBy(*keys).agg(F.max(ts).alias("last_beat")).withColumn("age", age).where(F.col("age") > timeout)
    )
