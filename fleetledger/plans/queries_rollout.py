"""Registered queries on schema rollout.

Shards come from ``customer`` with their last order as the time they were touched;
versions come from ``nation`` (a short release list) or ``part`` (a long one), with
gaps at the multiples of three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.operators import rollout as R
from fleetledger.plans.tables import seconds, table
from fleetledger.session import settle

NOW = "2001-08-02 00:00:00"


def _shards(spark, folder) -> DataFrame:
    last = table(spark, folder, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    key = F.col("c_custkey")
    good = F.concat(F.lit("app:secret@tcp(10.0.0."), key % 250, F.lit(":3306)"))
    # Every 31st shard has no DSN that can be read.
    dsn = F.when(key % 31 != 30, good).when(key % 2 == 0, F.lit("app:secret@(tcp:10.0.0.1)"))
    return (
        table(spark, folder, "customer", "c_custkey")
        .join(last, key == F.col("o_custkey"), "left")
        .select(
            key.alias("shardId"),
            F.concat(F.lit("shard_"), key).alias("schemaName"),
            dsn.alias("shardDSN"),
            (key % 20).cast("int").alias("version"),
            F.when(key % 7 == 0, F.concat(F.lit("task-"), key % 3)).alias("taskName"),
            F.col("last").alias("lastTaskHb"),
            F.col("last").alias("lastUpdate"),
        )
    )


def _versions(numbers: DataFrame) -> DataFrame:
    v = F.col("version")
    return numbers.where(v % 3 != 0).select(
        v,
        F.concat(F.lit("add column c"), v, F.lit(" int")).alias("command"),
        F.when(v % 2 == 0, F.lit(R.DIRECT)).otherwise(F.lit(R.ONLINE)).alias("cmdType"),
        F.lit(NOW).cast("timestamp").alias("lastUpdate"),
        F.concat(F.lit("t"), v % 5).alias("tableName"),
    )


def _short_list(spark, folder) -> DataFrame:
    return _versions(table(spark, folder, "nation", "n_nationkey").select((F.col("n_nationkey") + 1).alias("version")))


def _long_list(spark, folder) -> DataFrame:
    return _versions(table(spark, folder, "part", "p_partkey").select((F.col("p_partkey") + 1).alias("version")))


def _spread_shards(spark, folder) -> DataFrame:
    """Shards whose versions lie all over the long list, some beyond its end."""
    return table(spark, folder, "customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("shardId"), (F.col("c_custkey") * 2).alias("version"), "c_mktsegment"
    )


def rollout_max(spark, folder) -> DataFrame:
    return R.max_version(_long_list(spark, folder))


def rollout_next(spark, folder) -> DataFrame:
    return R.next_version(_spread_shards(spark, folder), _long_list(spark, folder))


def rollout_lookup(spark, folder) -> DataFrame:
    wanted = _spread_shards(spark, folder).where(F.col("c_mktsegment") == "BUILDING")
    found = R.get_shards(_shards(spark, folder), wanted)
    return found.select("shardId", "schemaName", F.col("version").cast("long").alias("version"), "taskName", seconds("lastUpdate").alias("updated"))


def rollout_versions(spark, folder) -> DataFrame:
    wanted = _spread_shards(spark, folder).where(F.col("c_mktsegment") == "BUILDING")
    return R.get_versions(_long_list(spark, folder), wanted).select("version", "command", "tableName", "cmdType")


def rollout_pick(spark, folder) -> DataFrame:
    picked = R.shards_to_upgrade(_shards(spark, folder), _short_list(spark, folder), 100)
    return picked.select("shardId", F.col("version").cast("long").alias("version"), seconds("lastUpdate").alias("updated"))


def _state(shards: DataFrame) -> DataFrame:
    return shards.select(
        "shardId", F.col("version").cast("long").alias("version"), "taskName",
        seconds("lastTaskHb").alias("beat"), seconds("lastUpdate").alias("updated"),
    )


def rollout_claim(spark, folder) -> DataFrame:
    return _state(R.claim(_shards(spark, folder), _short_list(spark, folder), "task-9", NOW, "40", 64))


def rollout_claim_many(spark, folder) -> DataFrame:
    """25 tasks at once; three of them hold shards, some may take none."""
    n = F.col("n_nationkey")
    limit = F.when(n % 7 == 3, F.lit(None)).when(n % 6 == 5, F.lit("soon")).otherwise((n * 37 % 900).cast("string"))
    tasks = table(spark, folder, "nation", "n_nationkey").select(F.concat(F.lit("task-"), n).alias("taskName"), limit.alias("limit"), (n * 40 + 60).alias("workers"))
    return _state(R.claim_many(_shards(spark, folder), _short_list(spark, folder), tasks, NOW))


def _beats(spark, folder) -> DataFrame:
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("shardId"),
        F.concat(F.lit("task-"), F.col("o_orderkey") % 3).alias("taskName"),
        F.timestamp_seconds(seconds("o_orderdate") + 86400 * 30).alias("ts"),
    )


def rollout_beats(spark, folder) -> DataFrame:
    return _state(R.apply_heartbeats(_shards(spark, folder), _beats(spark, folder))[0])


def rollout_beats_unmatched(spark, folder) -> DataFrame:
    lost = R.apply_heartbeats(_shards(spark, folder), _beats(spark, folder))[1]
    return lost.select("shardId", "taskName", seconds("ts").alias("beat"))


def _completions(spark, folder) -> DataFrame:
    done = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return done.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("shardId"),
        F.concat(F.lit("task-"), F.col("o_orderkey") % 3).alias("taskName"),
        (F.col("o_orderkey") % 50).cast("int").alias("version"),
        F.timestamp_seconds(seconds("o_orderdate") + 86400 * 30).alias("ts"),
    )


def rollout_done(spark, folder) -> DataFrame:
    return _state(R.apply_completions(_shards(spark, folder), _completions(spark, folder))[0])


def rollout_done_unmatched(spark, folder) -> DataFrame:
    lost = R.apply_completions(_shards(spark, folder), _completions(spark, folder))[1]
    return lost.select("shardId", "taskName", F.col("version").cast("long").alias("version"), seconds("ts").alias("finished"))


def _oplog(spark, folder) -> DataFrame:
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    message = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("starting SQL command: 'alter "), F.col("event_id"), F.lit("'")))
        .when(F.col("event_id") % 3 == 1, F.lit(R.COMPLETED_PREFIX))
        .otherwise(F.concat(F.lit("Error: ddl error "), F.col("event_id")))
    )
    rows = events.select(
        F.nullif(F.col("user_id"), F.lit(7)).alias("shardId"), F.nullif(F.length("event_type"), F.lit(6)).alias("version"), F.lit(0).cast("long").alias("seq"),
        F.concat(F.lit("task-"), F.col("user_id") % 3).alias("taskName"), message.alias("message"), F.lit("").alias("output"),
        F.when(F.col("event_id") % 3 == 2, F.lit("failed")).alias("err"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("lastUpdate"), "event_id",
    )
    order, hour = [F.col("lastUpdate"), F.col("event_id")], F.date_trunc("hour", "lastUpdate")
    cut = F.col("lastUpdate") < F.lit("2024-01-20").cast("timestamp")
    existing = settle(R.append_oplog(rows.limit(0), rows.where(F.coalesce(cut, F.lit(True))), order, hour))
    return R.append_oplog(existing, rows.where(F.coalesce(~cut, F.lit(False))), order, hour)


def rollout_oplog(spark, folder) -> DataFrame:
    return _oplog(spark, folder).select("event_id", "shardId", F.col("version").cast("long").alias("version"), "seq", "message")


def rollout_outcome(spark, folder) -> DataFrame:
    return R.last_outcome(_oplog(spark, folder)).select(
        "shardId", F.col("version").cast("long").alias("version"), "seq", "taskName", "status", "message", "err"
    )


def rollout_plan(spark, folder) -> DataFrame:
    plan = R.migration_plan(_shards(spark, folder), _short_list(spark, folder))
    return plan.select("shardId", F.col("step").cast("long").alias("step"), "version", "cmdType", "command")


def rollout_plan_rejects(spark, folder) -> DataFrame:
    return R.split_dsn(_shards(spark, folder))[1]


def rollout_plan_long(spark, folder) -> DataFrame:
    """Suppliers as shards near the end of the long list."""
    last = table(spark, folder, "part", "p_partkey").agg(F.max("p_partkey")).scalar()
    shards = table(spark, folder, "supplier", "s_suppkey").select(
        F.col("s_suppkey").alias("shardId"), F.lit("s").alias("schemaName"), F.lit("app@tcp(10.0.0.1)").alias("shardDSN"), (last - F.col("s_suppkey")).alias("version")
    )
    plan = R.migration_plan(shards, _long_list(spark, folder))
    return plan.select("shardId", F.col("step").cast("long").alias("step"), "version")


def rollout_stalled(spark, folder) -> DataFrame:
    return R.stalled(_shards(spark, folder), NOW, 86400 * 10).select("shardId", "taskName", seconds("lastTaskHb").alias("beat"))


def _dsns(spark, folder) -> DataFrame:
    key = F.col("s_suppkey")
    host = F.concat(F.lit("10.1.0."), key % 250, F.lit(":3306"))
    user = F.concat(F.lit("app"), key % 9)
    dsn = (
        F.when(key % 6 == 0, F.concat(user, F.lit(":p@ss@tcp("), host, F.lit(")/db"), key, F.lit("?parseTime=true")))
        .when(key % 6 == 1, F.concat(user, F.lit("@unix(/run/sql.sock)")))
        .when(key % 6 == 2, F.concat(user, F.lit(":pw@(tcp:"), host, F.lit(")")))
        .when(key % 6 == 3, F.lit(""))
        .when(key % 6 == 4, F.concat(user, F.lit(":pw@tcp("), host, F.lit(")")))
    )
    return table(spark, folder, "supplier", "s_suppkey", "s_name").select(
        key.alias("shardId"), F.col("s_name").alias("schemaName"), dsn.alias("shardDSN")
    )


def rollout_dsn(spark, folder) -> DataFrame:
    return R.split_dsn(_dsns(spark, folder))[0]


def rollout_dsn_rejects(spark, folder) -> DataFrame:
    return R.split_dsn(_dsns(spark, folder))[1]


_CTE = """
WITH last AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1),
shards AS (
  SELECT c_custkey AS shardId, 'shard_' || c_custkey AS schemaName, c_custkey % 20 AS version,
         CASE WHEN c_custkey % 7 = 0 THEN 'task-' || (c_custkey % 3) END AS taskName,
         last AS lastTaskHb, last AS lastUpdate
  FROM customer LEFT JOIN last ON c_custkey = o_custkey),
versions AS (
  SELECT n_nationkey + 1 AS version FROM nation WHERE (n_nationkey + 1) % 3 <> 0),
long_list AS (
  SELECT p_partkey + 1 AS version FROM part WHERE (p_partkey + 1) % 3 <> 0),
spread AS (SELECT c_custkey AS shardId, c_custkey * 2 AS version, c_mktsegment FROM customer),
beats AS (
  SELECT o_custkey AS shardId, 'task-' || (o_orderkey % 3) AS taskName, o_orderdate + INTERVAL 30 DAY AS ts FROM orders),
done AS (
  SELECT o_custkey AS shardId, 'task-' || (o_orderkey % 3) AS taskName, o_orderkey % 50 AS version, o_orderdate + INTERVAL 30 DAY AS ts
  FROM orders WHERE o_orderstatus = 'F'),
judged AS (
  SELECT d.*, s.shardId IS NOT NULL AND d.version > s.version AND (s.lastTaskHb IS NULL OR d.ts >= s.lastTaskHb) AS counts
  FROM done d LEFT JOIN shards s ON s.shardId = d.shardId AND s.taskName = d.taskName),
oplog AS (
  SELECT event_id, nullif(user_id, 7) AS shardId, nullif(length(event_type), 6) AS version,
         row_number() OVER (PARTITION BY nullif(user_id, 7), nullif(length(event_type), 6)
                            ORDER BY CASE WHEN event_id % 97 <> 0 THEN ts END NULLS FIRST, event_id) AS seq,
         'task-' || (user_id % 3) AS taskName,
         CASE event_id % 3 WHEN 0 THEN 'starting SQL command: ''alter ' || event_id || '''' WHEN 1 THEN 'Completed OK'
              ELSE 'Error: ddl error ' || event_id END AS message,
         CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS status,
         CASE WHEN event_id % 3 = 2 THEN 'failed' END AS err
  FROM events)
"""

_STATE = "epoch_us(lastTaskHb) // 1000000 AS beat, epoch_us(lastUpdate) // 1000000 AS updated"

QUERIES = {
    "rollout_max": (rollout_max, _CTE + "SELECT coalesce(max(version), 0) AS version FROM long_list"),
    "rollout_next": (
        rollout_next,
        _CTE + "SELECT shardId, version, (SELECT min(l.version) FROM long_list l WHERE l.version > s.version) AS nextVersion FROM spread s",
    ),
    "rollout_lookup": (
        rollout_lookup,
        _CTE
        + """SELECT s.shardId, s.schemaName, s.version, s.taskName, epoch_us(s.lastUpdate) // 1000000 AS updated
             FROM shards s JOIN customer c ON c.c_custkey = s.shardId WHERE c.c_mktsegment = 'BUILDING'""",
    ),
    "rollout_versions": (
        rollout_versions,
        _CTE
        + """SELECT version, 'add column c' || version || ' int' AS command, 't' || (version % 5) AS tableName,
                    CASE WHEN version % 2 = 0 THEN 'sql' ELSE 'pt-osc' END AS cmdType
             FROM long_list WHERE version IN (SELECT version FROM spread WHERE c_mktsegment = 'BUILDING')""",
    ),
    "rollout_pick": (
        rollout_pick,
        _CTE
        + """SELECT shardId, version, epoch_us(lastUpdate) // 1000000 AS updated FROM shards
             WHERE version < (SELECT max(version) FROM versions) AND taskName IS NULL
             ORDER BY lastUpdate NULLS FIRST, shardId LIMIT 100""",
    ),
    "rollout_claim": (
        rollout_claim,
        _CTE
        + """, ranked AS (
               SELECT shardId, row_number() OVER (ORDER BY lastUpdate NULLS FIRST, shardId) AS rn FROM shards
               WHERE version < (SELECT max(version) FROM versions) AND taskName IS NULL),
             chosen AS (SELECT shardId FROM ranked WHERE rn <= 40 - (SELECT count(*) FROM shards WHERE taskName = 'task-9'))
             SELECT s.shardId, s.version, CASE WHEN c.shardId IS NULL THEN s.taskName ELSE 'task-9' END AS taskName,
                    epoch_us(CASE WHEN c.shardId IS NULL THEN s.lastTaskHb ELSE TIMESTAMP '2001-08-02' END) // 1000000 AS beat,
                    epoch_us(CASE WHEN c.shardId IS NULL THEN s.lastUpdate ELSE TIMESTAMP '2001-08-02' END) // 1000000 AS updated
             FROM shards s LEFT JOIN chosen c ON c.shardId = s.shardId""",
    ),
    "rollout_claim_many": (
        rollout_claim_many,
        _CTE
        + """, ranked AS (
               SELECT shardId, row_number() OVER (ORDER BY lastUpdate NULLS FIRST, shardId) AS rn FROM shards
               WHERE version < (SELECT max(version) FROM versions) AND taskName IS NULL),
             tasks AS (SELECT 'task-' || n_nationkey AS task, n_nationkey * 40 + 60 AS workers,
                 CASE WHEN n_nationkey % 7 = 3 OR n_nationkey % 6 = 5 THEN 0 ELSE n_nationkey * 37 % 900 END AS lim FROM nation),
             free AS (SELECT task, greatest(least(lim, workers) - (SELECT count(*) FROM shards WHERE taskName = task), 0) AS n FROM tasks),
             spans AS (SELECT task, sum(n) OVER (ORDER BY task) AS until, n FROM free),
             chosen AS (SELECT shardId, task FROM ranked JOIN spans ON rn > until - n AND rn <= until)
             SELECT s.shardId, s.version, coalesce(c.task, s.taskName) AS taskName,
                    epoch_us(CASE WHEN c.shardId IS NULL THEN s.lastTaskHb ELSE TIMESTAMP '2001-08-02' END) // 1000000 AS beat,
                    epoch_us(CASE WHEN c.shardId IS NULL THEN s.lastUpdate ELSE TIMESTAMP '2001-08-02' END) // 1000000 AS updated
             FROM shards s LEFT JOIN chosen c ON c.shardId = s.shardId""",
    ),
    "rollout_beats": (
        rollout_beats,
        _CTE
        + """, newest AS (SELECT shardId, taskName, max(ts) AS ts FROM beats GROUP BY 1, 2)
             SELECT s.shardId, s.version, s.taskName,
                    epoch_us(greatest(s.lastTaskHb, n.ts)) // 1000000 AS beat,
                    epoch_us(CASE WHEN n.ts > s.lastTaskHb OR (n.ts IS NOT NULL AND s.lastTaskHb IS NULL) THEN n.ts ELSE s.lastUpdate END) // 1000000 AS updated
             FROM shards s LEFT JOIN newest n ON n.shardId = s.shardId AND n.taskName = s.taskName""",
    ),
    "rollout_beats_unmatched": (
        rollout_beats_unmatched,
        _CTE
        + """SELECT b.shardId, b.taskName, epoch_us(b.ts) // 1000000 AS beat FROM beats b
             WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE s.shardId = b.shardId AND s.taskName = b.taskName)""",
    ),
    "rollout_done": (
        rollout_done,
        _CTE
        + """, newest AS (
               SELECT shardId, taskName, ts, version FROM judged WHERE counts
               QUALIFY row_number() OVER (PARTITION BY shardId, taskName ORDER BY ts DESC, version DESC) = 1)
             SELECT s.shardId, coalesce(n.version, s.version) AS version,
                    CASE WHEN n.shardId IS NULL THEN s.taskName END AS taskName,
                    epoch_us(coalesce(n.ts, s.lastTaskHb)) // 1000000 AS beat, epoch_us(greatest(n.ts, s.lastUpdate)) // 1000000 AS updated
             FROM shards s LEFT JOIN newest n ON n.shardId = s.shardId AND n.taskName = s.taskName""",
    ),
    "rollout_done_unmatched": (
        rollout_done_unmatched,
        _CTE
        + "SELECT shardId, taskName, version, epoch_us(ts) // 1000000 AS finished FROM judged WHERE NOT counts",
    ),
    "rollout_oplog": (rollout_oplog, _CTE + "SELECT event_id, shardId, version, seq, message FROM oplog"),
    "rollout_outcome": (
        rollout_outcome,
        _CTE
        + """SELECT shardId, version, seq, taskName, status, message, err FROM oplog
             QUALIFY row_number() OVER (PARTITION BY shardId, version ORDER BY seq DESC) = 1""",
    ),
    "rollout_plan": (
        rollout_plan,
        _CTE
        + """SELECT s.shardId, row_number() OVER (PARTITION BY s.shardId ORDER BY v.version) AS step, v.version::BIGINT AS version,
                    CASE WHEN v.version % 2 = 0 THEN 'sql' ELSE 'pt-osc' END AS cmdType,
                    CASE WHEN v.version % 2 = 0 THEN 'alter table `t' || (v.version % 5) || '` add column c' || v.version || ' int'
                         ELSE 'pt-online-schema-change --execute --alter ''add column c' || v.version || ' int'' u=app,D=' || s.schemaName
                              || ',t=t' || (v.version % 5) END AS command
             FROM shards s JOIN versions v ON v.version > s.version WHERE s.shardId % 31 <> 30""",
    ),
    "rollout_plan_rejects": (
        rollout_plan_rejects,
        "SELECT c_custkey AS shardId, CASE WHEN c_custkey % 2 = 0 THEN 'malformed DSN' ELSE 'no DSN' END AS reason FROM customer WHERE c_custkey % 31 = 30",
    ),
    "rollout_plan_long": (
        rollout_plan_long,
        """WITH versions AS (SELECT p_partkey + 1 AS version FROM part WHERE (p_partkey + 1) % 3 <> 0),
                shards AS (SELECT s_suppkey AS shardId, (SELECT max(p_partkey) FROM part) - s_suppkey AS version FROM supplier)
           SELECT shardId, row_number() OVER (PARTITION BY shardId ORDER BY v.version) AS step, v.version::BIGINT AS version
           FROM shards s JOIN versions v ON v.version > s.version""",
    ),
    "rollout_stalled": (
        rollout_stalled,
        _CTE
        + """SELECT shardId, taskName, epoch_us(lastTaskHb) // 1000000 AS beat FROM shards
             WHERE taskName IS NOT NULL AND epoch(TIMESTAMP '2001-08-02') - epoch_us(lastTaskHb) // 1000000 > 864000""",
    ),
    "rollout_dsn": (
        rollout_dsn,
        """SELECT s_suppkey AS shardId, 'app' || (s_suppkey % 9) AS "user",
                  CASE WHEN s_suppkey % 6 = 1 THEN 'unix' ELSE 'tcp' END AS net,
                  CASE WHEN s_suppkey % 6 = 1 THEN '/run/sql.sock' ELSE '10.1.0.' || (s_suppkey % 250) || ':3306' END AS addr,
                  CASE WHEN s_suppkey % 6 = 0 THEN 'db' || s_suppkey ELSE s_name END AS "schema"
           FROM supplier WHERE s_suppkey % 6 IN (0, 1, 4)""",
    ),
    "rollout_dsn_rejects": (
        rollout_dsn_rejects,
        """SELECT s_suppkey AS shardId, CASE WHEN s_suppkey % 6 = 2 THEN 'malformed DSN' ELSE 'no DSN' END AS reason
           FROM supplier WHERE s_suppkey % 6 IN (2, 3, 5)""",
    ),
}
