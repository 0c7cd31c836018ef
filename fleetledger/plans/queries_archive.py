"""Registered queries on log segments.

A segment is a day of one user's events; its last event is its change time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.operators import archive as A
from fleetledger.operators import changelog as C
from fleetledger.plans.tables import seconds, table
from fleetledger.session import shared_folder
from fleetledger.sources.event_text import read_events, segment_number
from fleetledger.sources.segments import segments
from fleetledger.streaming.heartbeats import heartbeat_gaps
from fleetledger.streaming.silence import silence_alerts, timers
from fleetledger.streaming.ingest import ingest_stream

NOW = "2024-01-31 00:00:00"


def _inventory(spark, folder) -> DataFrame:
    user, day = F.col("user_id"), F.dayofyear("ts")
    prefix = F.when(user % 11 == 0, F.lit("other.")).otherwise(F.lit("bin."))
    return (
        table(spark, folder, "events", "user_id", "ts")
        .groupBy("user_id", day.alias("day"))
        .agg(F.max("ts").alias("mtime"), F.count(F.lit(1)).alias("bytes"))
        .select(
            F.concat(F.lit("u"), user).alias("source"),
            F.concat(prefix, F.lpad(F.col("day").cast("string"), 6, "0"), F.when(F.col("day") % 4 == 0, F.lit(".xz")).otherwise(F.lit(""))).alias("name"),
            F.col("day").cast("long").alias("seq"), "mtime", "bytes",
        )
    )


def archive_retain(spark, folder) -> DataFrame:
    return A.retain(_inventory(spark, folder), 10, NOW, "bin.").select("source", "name", seconds("mtime").alias("mtime"))


def archive_expired(spark, folder) -> DataFrame:
    return A.expired(_inventory(spark, folder), 10, NOW, "bin.").select("source", "name", seconds("mtime").alias("mtime"))


def archive_compact(spark, folder) -> DataFrame:
    return A.finished(_inventory(spark, folder), "bin.").select("source", "name", "bytes")


def archive_resume(spark, folder) -> DataFrame:
    reported = table(spark, folder, "customer", "c_custkey").select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("source"), F.lit("bin.000001").alias("name")
    )
    return A.last_segment(_inventory(spark, folder), reported)


def _write_segments(spark, folder) -> str:
    """Events as event text, a folder per day: ``file=bin.000012``."""
    path = shared_folder(spark, "segments")
    stamp = F.date_format("ts", "yyMMdd H:mm:ss")
    body = F.concat(
        F.lit("# at "), F.col("event_id") + 4, F.lit("\n#"), stamp, F.lit(" server id 1  end_log_pos "), F.col("event_id") + 5,
        F.lit(" CRC32 0x1f \tQuery\n-- "), F.col("event_type"), F.lit(" "), F.col("props"),
    )
    name = F.concat(F.lit("bin."), F.lpad(F.dayofyear("ts").cast("string"), 6, "0"))
    table(spark, folder, "events", "event_id", "ts", "event_type", "props").select(name.alias("file"), body.alias("value")).write.partitionBy("file").text(path)
    return path


def archive_segments(spark, folder) -> DataFrame:
    listed = segments(spark, _write_segments(spark, folder), "part-", recursive=True).where("bytes > 0")
    folders = listed.groupBy(F.regexp_replace("source", "^.*file=", "").alias("segment"))
    return folders.agg(F.max(segment_number(F.regexp_replace("source", "^.*file=", ""))).alias("seq"), F.sum("bytes").cast("long").alias("bytes"))


def archive_stream(spark, folder) -> DataFrame:
    source, out, mark = _write_segments(spark, folder), shared_folder(spark, "ingested"), shared_folder(spark, "mark")
    ingest_stream(spark, source, out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("file").agg(F.count(F.lit(1)).alias("n_events"), F.sum("pos").alias("pos_sum"))


def archive_rewrite(spark, folder) -> DataFrame:
    """Text, inventory, archive, and the archive read back; a second run finds everything archived."""
    path, target = _write_segments(spark, folder), shared_folder(spark, "archive")
    parts = segments(spark, path, "part-", recursive=True)
    inventory = parts.select(F.lit("main").alias("source"), F.regexp_replace("source", "^.*file=", "").alias("name")).distinct()
    inventory = inventory.withColumn("seq", segment_number(F.col("name")))
    events = read_events(spark, path).withColumn("source", F.lit("main"))
    A.compact(events, inventory, target, "bin.")
    A.compact(events, inventory, target, "bin.", A.archived_segments(spark, target))
    kept = C.parse_headers(A.read_archive(spark, target))
    text = F.trim(F.substring_index("record", "\n-- ", -1), F.lit("\n"))
    return kept.select("file", "file_no", "pos", F.unix_timestamp("event_time").alias("event_s"), text.alias("text"))


def heartbeat_stream(spark, folder) -> DataFrame:
    """Sessions that a stream reports: those whose silence ended before the watermark."""
    source, out, mark = (shared_folder(spark, p) for p in ("beats", "sessions", "mark"))
    table(spark, folder, "events", "user_id", "event_type", "ts").write.parquet(source)
    beats = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    sessions = heartbeat_gaps(beats, 21600, ("user_id", "event_type"))
    writer = sessions.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type", seconds("started").alias("started"), seconds("last_beat").alias("last_beat"), "beats")


def silence_stream(spark, folder) -> DataFrame:
    """Silences and returns that a stream tells until its watermark."""
    source, out, mark = (shared_folder(spark, p) for p in ("beats", "alerts", "mark"))
    table(spark, folder, "events", "user_id", "event_type", "ts").write.parquet(source)
    beats = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    told = silence_alerts(beats, 21600, ("user_id", "event_type"))
    writer = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True)
    with timers(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type", "kind", seconds("last_beat").alias("last_beat"), seconds("at").alias("at_s"))


_CTE = """
WITH inventory AS (
  SELECT 'u' || user_id AS source,
         (CASE WHEN user_id % 11 = 0 THEN 'other.' ELSE 'bin.' END) || lpad(dayofyear(ts)::VARCHAR, 6, '0')
           || (CASE WHEN dayofyear(ts) % 4 = 0 THEN '.xz' ELSE '' END) AS name,
         dayofyear(ts) AS seq, max(ts) AS mtime, count(*) AS bytes
  FROM events GROUP BY user_id, dayofyear(ts)),
aged AS (SELECT *, floor(date_diff('microsecond', mtime, TIMESTAMP '2024-01-31') / 86400000000.0) > 10 AND name LIKE 'bin.%' AS gone FROM inventory),
days AS (
  SELECT 'bin.' || lpad(dayofyear(ts)::VARCHAR, 6, '0') AS file, count(*) AS n_events, sum(event_id + 4)::BIGINT AS pos_sum
  FROM events GROUP BY 1)
"""

QUERIES = {
    "archive_segments": (
        archive_segments,
        """SELECT 'bin.' || lpad(dayofyear(ts)::VARCHAR, 6, '0') AS segment, dayofyear(ts) AS seq,
                  sum(length('# at ' || (event_id + 4) || chr(10) || '#240101 ' || strftime(ts, '%-H:%M:%S') || ' server id 1  end_log_pos ' || (event_id + 5)
                      || ' CRC32 0x1f ' || chr(9) || 'Query' || chr(10) || '-- ' || event_type || ' ' || props) + 1)::BIGINT AS bytes
           FROM events GROUP BY ALL""",
    ),
    "archive_retain": (archive_retain, _CTE + "SELECT source, name, epoch_us(mtime) // 1000000 AS mtime FROM aged WHERE NOT gone"),
    "archive_expired": (archive_expired, _CTE + "SELECT source, name, epoch_us(mtime) // 1000000 AS mtime FROM aged WHERE gone"),
    "archive_compact": (
        archive_compact,
        _CTE
        + """SELECT source, name, bytes FROM inventory WHERE name LIKE 'bin.%' AND name NOT LIKE '%.xz'
             QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC, name DESC) > 1""",
    ),
    "archive_resume": (
        archive_resume,
        _CTE
        + """, newest AS (SELECT source, name FROM inventory QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC, name DESC) = 1)
             SELECT coalesce(n.source, 'u' || c_custkey) AS source, coalesce(n.name, 'bin.000001') AS name
             FROM newest n FULL JOIN customer ON n.source = 'u' || c_custkey""",
    ),
    "archive_stream": (archive_stream, _CTE + "SELECT * FROM days"),
    "archive_rewrite": (
        archive_rewrite,
        """WITH e AS (SELECT *, 'bin.' || lpad(dayofyear(ts)::VARCHAR, 6, '0') AS file FROM events)
           SELECT file, dayofyear(ts) AS file_no, event_id + 4 AS pos, epoch_us(ts) // 1000000 AS event_s, event_type || ' ' || props AS text
           FROM e WHERE file < (SELECT max(file) FROM e)""",
    ),
    "links_silence_stream": (
        silence_stream,
        """
        WITH w AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) // 1000 AS passed FROM events),
        e AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events),
        b AS (SELECT *, lag(s) OVER k AS before, lead(s) OVER k IS NULL AS newest FROM e WHERE s <= (SELECT passed FROM w) WINDOW k AS (PARTITION BY user_id, event_type ORDER BY s))
        SELECT user_id, event_type, 'silent' AS kind, before AS last_beat, before + 21600 AS at_s FROM b WHERE s - before > 21600
        UNION ALL SELECT user_id, event_type, 'back', before, s FROM b WHERE s - before > 21600
        UNION ALL SELECT user_id, event_type, 'silent', s, s + 21600 FROM b WHERE newest AND (SELECT passed FROM w) > s + 21600""",
    ),
    "links_gaps_stream": (
        heartbeat_stream,
        """
        WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000000 AS s FROM events),
        steps AS (SELECT *, lag(s) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS before FROM e),
        parts AS (SELECT *, sum(CASE WHEN s - before > 21600 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS part FROM steps)
        SELECT user_id, event_type, min(s) AS started, max(s) AS last_beat, count(*) AS beats FROM parts
        GROUP BY user_id, event_type, part HAVING max(s) + 21600 <= (SELECT max(s) - 600 FROM e)""",
    ),
}
