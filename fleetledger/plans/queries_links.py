"""Registered queries on replication links.

The state table is made from ``events`` (a user is a host, an event type or a pair of
clusters is a connection, the last event is the last heartbeat), hosts and clusters
from ``supplier`` and ``nation``.  The tables span a month, so the timeout is two days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.operators import links as L
from fleetledger.operators.reach import reach
from fleetledger.plans import reconcile as P
from fleetledger.plans.tables import seconds, table
from fleetledger.session import settle, shared_folder
from fleetledger.streaming import reconcile as S
from fleetledger.streaming.heartbeats import heartbeat_gaps, silent_now

NOW = "2024-01-31 00:00:00"
TIMEOUT = 172800
#: Days after NOW at which the stream of reports has a snapshot.
DAYS = (0, 1, 3, 6)


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _host(column: str = "user_id"):
    return _text("h", F.col(column))


def _pick(number, *values):
    """One of ``values`` by remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _repl(spark, folder) -> DataFrame:
    user = F.col("user_id")
    return (
        table(spark, folder, "events", "user_id", "event_type", "ts")
        .groupBy("user_id", "event_type")
        .agg(F.max("ts").alias("lastHeartbeat"), F.min("ts").alias("lastUpdate"))
        .select(
            _host().alias("host"), (user % 5).cast("int").alias("weight"), (user % 3).cast("int").alias("localIndex"),
            _pick(user + F.length("event_type"), "Yes", "No", "Proposed", "Failed").alias("isSlave"),
            "lastUpdate", "lastHeartbeat", F.col("event_type").alias("connectionName"),
        )
    )


def _repl_rows(repl: DataFrame) -> DataFrame:
    return repl.select(
        "host", F.col("weight").cast("long").alias("weight"), F.col("localIndex").cast("long").alias("localIndex"), "isSlave",
        seconds("lastUpdate").alias("updated"), seconds("lastHeartbeat").alias("beat"), "connectionName",
    )


def links_led(spark, folder) -> DataFrame:
    return L.links_led(_repl(spark, folder))


def links_rank(spark, folder) -> DataFrame:
    ranked = L.rank_candidates(_repl(spark, folder), NOW, TIMEOUT)
    return ranked.select("connectionName", "rank", "host", F.col("weight").cast("long").alias("weight"), "load")


def links_best(spark, folder) -> DataFrame:
    return L.best_candidates(_repl(spark, folder), NOW, TIMEOUT)


def links_leader(spark, folder) -> DataFrame:
    return L.current_leader(_repl(spark, folder), NOW)


def links_stale(spark, folder) -> DataFrame:
    return L.stale_leaders(_repl(spark, folder), NOW, 3600)


def links_demote(spark, folder) -> DataFrame:
    return _repl_rows(L.demote_stale(_repl(spark, folder), NOW, 3600))


def links_dup(spark, folder) -> DataFrame:
    return L.duplicate_leaders(_repl(spark, folder), NOW, TIMEOUT)


def links_guard(spark, folder) -> DataFrame:
    return L.live_proposal(_repl(spark, folder), NOW, TIMEOUT).select("connectionName", "host", "isSlave", "proposed")


def links_clear(spark, folder) -> DataFrame:
    # Failures age by their last beat here, so that both sides of the limit occur.
    aged = _repl(spark, folder).withColumn("lastUpdate", F.col("lastHeartbeat"))
    return _repl_rows(L.clear_failed(aged, NOW, TIMEOUT // 2))


def _status_values(spark, folder) -> DataFrame:
    """Every event reports one of the five node values of its host."""
    user, kind = F.col("user_id"), F.col("event_type")
    name = (
        F.when(kind == "view", F.lit("wsrep_cluster_name")).when(kind == "click", F.lit("wsrep_node_name"))
        .when(kind == "error", F.lit("wsrep_local_index")).when(kind == "purchase", F.lit("wsrep_cluster_status"))
        .when(kind == "signup", F.lit("wsrep_local_state"))
    )
    value = (
        F.when(kind == "view", _text("C", user % 25)).when(kind == "click", _host())
        .when(kind == "error", (F.floor(user / 25) % 5).cast("string"))
        .when(kind == "purchase", F.when(user % 10 == 9, F.lit("non-Primary")).otherwise(F.lit("Primary")))
        .when(kind == "signup", _pick(user, "4", "2", "4", "4", "2", "4", "4", "1"))
    )
    return table(spark, folder, "events", "user_id", "event_type").select(_host().alias("host"), name.alias("name"), value.alias("value"))


def _nodes(spark, folder) -> DataFrame:
    return L.nodes_from_status(L.pivot_status(_status_values(spark, folder))).where(F.col("cluster").isNotNull())


def links_status_rejects(spark, folder) -> DataFrame:
    """Nodes that cannot be placed, and why: every seventh host does not name itself, every eleventh no cluster."""
    user, name = F.substring("host", 2, 20).cast("long"), F.col("name")
    left_out = ((user % 7 == 3) & (name == "wsrep_node_name")) | ((user % 11 == 5) & (name == "wsrep_cluster_name"))
    return L.unplaced_nodes(L.pivot_status(_status_values(spark, folder).where(~left_out)))


def links_status(spark, folder) -> DataFrame:
    return _nodes(spark, folder).select("cluster", "host", F.col("localIndex").cast("long").alias("localIndex"), F.col("sane").cast("int").cast("long").alias("sane"))


def _status_text(io_state, master, io, sql, error):
    return _text(
        "*************************** 1. row ***************************\n",
        "               Slave_IO_State: ", io_state, "\n                  Master_Host: ", master,
        "\n             Slave_IO_Running: ", io, "\n            Slave_SQL_Running: ", sql, "\n                   Last_Error: ", error, "\n",
    )


def links_parse(spark, folder) -> DataFrame:
    event = F.col("event_id")
    text = _status_text(
        _pick(event, "Waiting for master to send event", "Connecting to master", "Reconnecting after a failed read", ""),
        F.when(event % 5 == 0, F.lit("")).otherwise(_text("10.0.0.", F.col("user_id") % 250)),
        _pick(event, "Yes", "Connecting", "No", "Yes"), F.when(event % 3 == 0, F.lit("No")).otherwise(F.lit("Yes")), F.col("props"),
    )
    texts = table(spark, folder, "events", "event_id", "user_id", "props").select("event_id", text.alias("text"))
    parsed = L.with_health(L.parse_link_status(texts))
    return parsed.select(
        "event_id", F.col("Master_Host").alias("master"), F.col("Slave_IO_State").alias("io_state"), F.col("Slave_IO_Running").alias("io"),
        F.col("Slave_SQL_Running").alias("sql_state"), F.col("healthy").cast("int").cast("long").alias("healthy"),
        F.col("replicating").cast("int").cast("long").alias("replicating"),
    )


def links_channel(spark, folder) -> DataFrame:
    events = table(spark, folder, "events", "user_id", "event_type", "value")
    pairs = events.select(_host().alias("host"), F.col("event_type").alias("connectionName"), "value")
    return L.channel_exists(pairs.where(F.col("value") > 60), pairs.select("host", "connectionName").distinct())


def _edges(spark, folder, *steps: int) -> DataFrame:
    n = F.col("n_nationkey")
    step = F.explode(F.array(*[F.lit(s) for s in steps])).alias("k")
    return table(spark, folder, "nation", "n_nationkey").select(n, step).select(
        _text("C", n).alias("clusterSlave"), _text("C", (n + F.col("k")) % 25).alias("clusterMaster")
    )


def _supplier_nodes(spark, folder) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier", "s_suppkey", "s_nationkey").select(
        key, _text("C", F.col("s_nationkey")).alias("cluster"), _text("s", key).alias("host"),
        (key % 4).cast("int").alias("localIndex"), (key % 9 != 8).alias("sane"),
    )


def _supplier_weights(spark, folder) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where(F.col("s_acctbal") > 0)
    return rows.select(_text("C", F.col("s_nationkey")).alias("cluster"), _text("s", key).alias("nodename"), (key % 7 + 1).cast("int").alias("weight"))


def links_topology(spark, folder) -> DataFrame:
    return L.connections(_supplier_nodes(spark, folder), _edges(spark, folder, 1, 2)).select("host", "cluster", "clusterMaster", "connectionName")


def links_reach(spark, folder) -> DataFrame:
    """Ten suppliers are clusters in a chain; in some tens the chain bites its tail, some have more masters, some replicate from themselves."""
    key = F.col("s_suppkey")
    place, ten = key % 10, F.floor(key / 10)
    masters = F.array_compact(
        F.array(
            F.when(place.between(1, 7), key - 1), F.when((place == 0) & (ten % 3 == 1), key + 3), F.when(place == 8, key - 6),
            F.when((place == 8) & (ten > 0), key - 13), F.when((place == 9) & (ten % 4 == 1), key), F.when(place == 9, key - 2),
        )
    )
    link = table(spark, folder, "supplier", "s_suppkey").select(_text("C", key).alias("clusterSlave"), F.explode(masters).alias("master"))
    return reach(link.select("clusterSlave", _text("C", F.col("master")).alias("clusterMaster")))


def links_weight(spark, folder) -> DataFrame:
    out = L.with_weight(_supplier_nodes(spark, folder), _supplier_weights(spark, folder))
    return out.select("cluster", "host", F.col("weight").cast("long").alias("weight"))


def links_register(spark, folder) -> DataFrame:
    pairs = L.connections(_supplier_nodes(spark, folder), _edges(spark, folder, 1))
    key = F.col("s_suppkey")
    known = pairs.where(key % 3 != 0).select(
        "host", F.lit(1).alias("weight"), "localIndex",
        F.when((key % 5 == 1) & (F.substring("cluster", -1, 1) < "5"), F.lit("Yes")).otherwise(F.lit("No")).alias("isSlave"),
        F.lit("2024-01-30").cast("timestamp").alias("lastUpdate"), F.lit("2024-01-30").cast("timestamp").alias("lastHeartbeat"), "connectionName",
    )
    status = pairs.where(key % 2 == 0).select("host", "connectionName", F.lit("m").alias("Master_Host"))
    return _repl_rows(L.register(pairs.drop("s_suppkey"), known, status, _supplier_weights(spark, folder), NOW))


def links_master(spark, folder) -> DataFrame:
    """Four neighbouring suppliers are the master candidates of one cluster."""
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier", "s_suppkey", "s_acctbal").withColumn("cluster", _text("K", F.floor(key / 4)))
    lists = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-key).alias("at"), _text("s", key).alias("name")))).alias("l"))
    cluster = lists.select("cluster", F.array_join("l.name", " ").alias("masterCandidates"))
    probes = rows.select(
        "cluster", _text("s", key).alias("candidate"), F.when(F.col("s_acctbal") > 2000, F.lit("Yes")).otherwise(F.lit("No")).alias("Slave_IO_Running"),
        F.lit("Yes").alias("Slave_SQL_Running"), F.when(key % 5 == 0, F.lit("Connecting to master")).otherwise(F.lit("Waiting")).alias("Slave_IO_State"),
    )
    return L.choose_master(cluster, probes)


def _places(spark, folder) -> DataFrame:
    """Hosts on two links per cluster."""
    user, k = F.col("user_id"), F.col("k")
    nth = F.floor(user / 25)
    kinds = {"view": "b1", "click": "b2", "error": "u1", "purchase": "u2"}
    return settle(
        table(spark, folder, "events", "user_id", "event_type", "ts")
        .groupBy("user_id")
        .agg(*[F.max(F.when(F.col("event_type") == kind, F.col("ts"))).alias(name) for kind, name in kinds.items()])
        .withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
        .select(
            user, k, nth.alias("nth"), _host().alias("host"), _text("C", (user % 25 + k) % 25).alias("master"),
            _text("C", user % 25, "-C", (user % 25 + k) % 25).alias("connectionName"),
            F.when(k == 1, F.col("b1")).otherwise(F.col("b2")).alias("lastHeartbeat"),
            F.when(k == 1, F.col("u1")).otherwise(F.col("u2")).alias("lastUpdate"),
        )
    )


def _fleet(spark, folder) -> dict:
    """All inputs of the reconciliation."""
    users, user, k, nth = _places(spark, folder), F.col("user_id"), F.col("k"), F.col("nth")
    known = users.where(((user + k) % 6 != 5) & F.col("lastHeartbeat").isNotNull() & F.col("lastUpdate").isNotNull())
    repl = known.select(
        "host", (user % 2).cast("int").alias("weight"), F.when(user % 13 != 0, (nth + 1) % 5).cast("int").alias("localIndex"),
        _pick(user * 7 + nth + k, "No", "Yes", "Proposed", "Failed").alias("isSlave"), "lastUpdate", "lastHeartbeat", "connectionName",
    )
    text = _status_text(
        F.lit("Waiting for master to send event"), F.when((user * 5 + k) % 3 == 0, F.lit("10.0.0.1")).otherwise(F.lit("")),
        _pick(user * 3 + nth * 2 + k, "Yes", "Yes", "Connecting", "No"), _pick(user + nth, "Yes", "Yes", "No", "Connecting"), F.lit("none"),
    )
    status = L.parse_link_status(users.where((user * 5 + k) % 3 != 2).select("host", "connectionName", text.alias("text")))
    lists = table(spark, folder, "nation", "n_nationkey").select(
        _text("C", F.col("n_nationkey")).alias("cluster"), _text("m", F.col("n_nationkey"), "a m", F.col("n_nationkey"), "b").alias("masterCandidates")
    )

    def probe(letter: str, good):
        return F.struct(
            _text(F.concat(F.lit("m"), F.substring("master", 2, 3)), letter).alias("candidate"),
            F.when(good, F.lit("Yes")).otherwise(F.lit("No")).alias("io"),
        )

    tries = F.explode(F.array(probe("a", (user + k) % 3 == 0), probe("b", (user + 2 * k) % 4 == 0))).alias("p")
    probes = users.select("host", F.col("master").alias("cluster"), tries).select(
        "host", "cluster", "p.candidate", F.col("p.io").alias("Slave_IO_Running"), F.lit("Yes").alias("Slave_SQL_Running"), F.lit("Waiting").alias("Slave_IO_State")
    )
    masters = users.select("host", "master", "connectionName").join(
        L.choose_master(lists, probes).select("host", F.col("cluster").alias("master")), ["host", "master"], "left_semi"
    )
    weight = users.where((k == 1) & (user % 4 == 1)).select(
        _text("C", user % 25).alias("cluster"), F.col("host").alias("nodename"), F.lit(1).alias("weight")
    )
    return {
        "repl": repl, "nodes": _nodes(spark, folder), "link_status": status, "link": _edges(spark, folder, 1, 2),
        "weight": weight, "masters": masters, "now": NOW, "timeout": TIMEOUT,
    }


def links_reconcile(spark, folder) -> DataFrame:
    out = P.reconcile(**_fleet(spark, folder))
    return out.select(
        "host", "connectionName", F.col("weight").cast("long").alias("weight"), F.col("localIndex").cast("long").alias("localIndex"), "isSlave",
        seconds("lastUpdate").alias("updated"), seconds("lastHeartbeat").alias("beat"), "previous", "rule", "action",
        F.size("alerts").cast("long").alias("n_alerts"),
    )


def links_alerts(spark, folder) -> DataFrame:
    return P.alerts(P.reconcile(**_fleet(spark, folder)))


def _reports(spark, folder, day: int) -> DataFrame:
    """What four fifths of the nodes report ``day`` days after NOW."""
    users, user, k, nth = _places(spark, folder), F.col("user_id"), F.col("k"), F.col("nth")
    return users.join(_nodes(spark, folder), "host").where((user + day) % 5 != 4).select(
        (F.lit(NOW).cast("timestamp") + F.make_dt_interval(F.lit(day))).alias("at"), "cluster", "host", "localIndex", "sane", "connectionName",
        F.when((user * 5 + k + day) % 3 == 0, F.lit("10.0.0.1")).alias("Master_Host"), F.lit("Waiting").alias("Slave_IO_State"),
        _pick(user * 3 + nth * 2 + k + day, "Yes", "Yes", "Connecting", "No").alias("Slave_IO_Running"),
        _pick(user + nth + day, "Yes", "Yes", "No", "Connecting").alias("Slave_SQL_Running"),
        (((user + k + day) % 3 == 0) | ((user + 2 * k + day) % 4 == 0)).alias("reachable"),
    )


def links_reconcile_stream(spark, folder) -> DataFrame:
    """Four snapshots from a stream of reports, each judged on what the one before left."""
    own, fleet = shared_folder(spark, "link-reports"), _fleet(spark, folder)
    for day in DAYS:
        _reports(spark, folder, day).write.parquet(f"{own}/source/{day}")
    stream = spark.readStream.schema(S.REPORT).option("maxFilesPerTrigger", 2).parquet(f"{own}/source/*")
    S.start_reconcile(stream, fleet["repl"], fleet["link"], fleet["weight"], f"{own}/state", f"{own}/mark", TIMEOUT).awaitTermination()
    S.judge_open(spark, f"{own}/state", fleet["link"], fleet["weight"], TIMEOUT)
    return S.snapshots(spark, f"{own}/state").select(
        seconds("at").alias("at"), "host", "connectionName", F.col("weight").cast("long").alias("weight"),
        F.col("localIndex").cast("long").alias("localIndex"), "isSlave", seconds("lastUpdate").alias("updated"),
        seconds("lastHeartbeat").alias("beat"), "previous", "rule", "action", F.size("alerts").cast("long").alias("n_alerts"),
    )


def links_gaps(spark, folder) -> DataFrame:
    beats = table(spark, folder, "events", "user_id", "ts")

    def sessions(gap: int) -> DataFrame:
        return heartbeat_gaps(beats, gap, ("user_id",)).select(
            F.lit(gap).cast("long").alias("gap"), "user_id", seconds("started").alias("started"), seconds("last_beat").alias("last_beat"),
            seconds("silent_from").alias("silent_from"), "beats",
        )

    return sessions(21600).unionByName(sessions(179))


def links_silent(spark, folder) -> DataFrame:
    beats = table(spark, folder, "events", "user_id", "event_type", "ts")
    silent = silent_now(beats, NOW, TIMEOUT, ("user_id", "event_type"))
    return silent.select("user_id", "event_type", seconds("last_beat").alias("last_beat"), "age")


_REPL = """
WITH repl AS (
  SELECT 'h' || user_id AS host, user_id % 5 AS weight, user_id % 3 AS localIndex,
         CASE (user_id + length(event_type)) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Proposed' ELSE 'Failed' END AS isSlave,
         epoch_us(min(ts)) // 1000000 AS updated, epoch_us(max(ts)) // 1000000 AS beat, event_type AS connectionName,
         epoch_us(TIMESTAMP '2024-01-31') // 1000000 - epoch_us(max(ts)) // 1000000 AS age
  FROM events GROUP BY user_id, event_type),
led AS (SELECT host, count(*) FILTER (isSlave = 'Yes') AS links FROM repl GROUP BY host),
ranked AS (
  SELECT connectionName, host, weight, links AS load,
         row_number() OVER (PARTITION BY connectionName ORDER BY weight DESC, localIndex + links * 3 NULLS FIRST, host) AS rank
  FROM repl JOIN led USING (host) WHERE isSlave <> 'Failed' AND age < 172800),
leader AS (
  SELECT connectionName, host AS leader, age FROM repl WHERE isSlave = 'Yes'
  QUALIFY row_number() OVER (PARTITION BY connectionName ORDER BY localIndex, host) = 1)
"""

_NODES = """
WITH pivoted AS (
  SELECT user_id,
         max(CASE WHEN event_type = 'view' THEN 'C' || (user_id % 25) END) AS cluster,
         max(CASE WHEN event_type = 'click' THEN 'h' || user_id END) AS host,
         max(CASE WHEN event_type = 'error' THEN (user_id // 25) % 5 END) AS localIndex,
         coalesce(max(CASE WHEN event_type = 'purchase' THEN (user_id % 10 <> 9)::INT END), 0)
           * coalesce(max(CASE WHEN event_type = 'signup' THEN (user_id % 8 <> 7)::INT END), 0) AS sane
  FROM events GROUP BY user_id),
nodes AS (SELECT * FROM pivoted WHERE cluster IS NOT NULL AND host IS NOT NULL)
"""

_SIDE = (
    _NODES
    + """,
users AS (
  SELECT user_id, max(ts) FILTER (event_type = 'view') AS b1, max(ts) FILTER (event_type = 'click') AS b2,
         max(ts) FILTER (event_type = 'error') AS u1, max(ts) FILTER (event_type = 'purchase') AS u2
  FROM events GROUP BY user_id),
spots AS (
  SELECT user_id, k, user_id // 25 AS nth, 'h' || user_id AS host,
         'C' || (user_id % 25) || '-C' || ((user_id % 25 + k) % 25) AS conn,
         epoch_us(CASE WHEN k = 1 THEN b1 ELSE b2 END) // 1000000 AS beat,
         epoch_us(CASE WHEN k = 1 THEN u1 ELSE u2 END) // 1000000 AS updated
  FROM users CROSS JOIN (VALUES (1), (2)) AS steps(k)),
now_at AS (SELECT epoch_us(TIMESTAMP '2024-01-31') // 1000000 AS now_s),
side AS (
  SELECT s.user_id, s.k, s.nth, s.host, s.conn, 'C' || (s.user_id % 25) AS cluster, n.host IS NOT NULL AS reports,
         n.host IS NOT NULL AND n.sane = 1 AS sane, n.localIndex AS nodeIndex,
         CASE WHEN s.user_id % 4 = 1 THEN 1 ELSE 0 END AS nodeWeight,
         (s.user_id * 5 + s.k) % 3 = 0 AS replicating,
         CASE (s.user_id * 3 + s.nth * 2 + s.k) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Connecting' ELSE 'No' END AS io,
         CASE (s.user_id + s.nth) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Connecting' END AS sq,
         (s.user_id + s.k) % 3 = 0 OR (s.user_id + 2 * s.k) % 4 = 0 AS reachable,
         (s.user_id + s.k) % 6 <> 5 AND s.beat IS NOT NULL AND s.updated IS NOT NULL AS known,
         s.user_id % 2 AS weight, CASE WHEN s.user_id % 13 <> 0 THEN (s.nth + 1) % 5 END AS localIndex,
         CASE (s.user_id * 7 + s.nth + s.k) % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Proposed' ELSE 'Failed' END AS state,
         s.beat, s.updated, now_s
  FROM spots s LEFT JOIN nodes n ON n.host = s.host CROSS JOIN now_at),
"""
)

_SNAP = """
snap AS (
  SELECT host, conn, cluster, reports, sane, nodeIndex, nodeWeight, replicating, io, sq, reachable, now_s,
         CASE WHEN known THEN weight END AS weight0, CASE WHEN known THEN localIndex END AS index0,
         CASE WHEN known THEN state END AS state0, CASE WHEN known THEN beat END AS beat0, CASE WHEN known THEN updated END AS updated0,
         reports AND sane AND NOT replicating AS idle
  FROM side WHERE reports OR known),
"""

#: From one snapshot to the new states and the alerts.
_RULES = """
leader AS (
  SELECT conn, host AS leader, now_s - beat0 AS age FROM snap WHERE state0 = 'Yes'
  QUALIFY row_number() OVER (PARTITION BY conn ORDER BY index0 NULLS FIRST, host) = 1),
watched AS (SELECT DISTINCT conn FROM snap WHERE idle),
normal AS (
  SELECT s.*, l.leader, l.leader IS NULL OR l.age > 172800 AS open_seat,
         s.idle AND s.state0 IS NULL AS t1, coalesce(s.idle AND s.state0 = 'Failed' AND s.now_s - s.updated0 > 345600, FALSE) AS t2,
         coalesce(l.age > 172800 AND l.leader = s.host AND w.conn IS NOT NULL, FALSE) AS silenced
  FROM snap s LEFT JOIN leader l ON l.conn = s.conn LEFT JOIN watched w ON w.conn = s.conn),
phase1 AS (
  SELECT *, CASE WHEN t1 OR t2 OR silenced THEN 'No' ELSE state0 END AS state1,
         CASE WHEN t1 THEN nodeWeight ELSE weight0 END AS weight1, CASE WHEN t1 OR t2 THEN nodeIndex ELSE index0 END AS index1,
         CASE WHEN t1 OR t2 THEN now_s ELSE beat0 END AS beat1
  FROM normal),
load AS (SELECT host, count(*) FILTER (state1 = 'Yes') AS load FROM phase1 WHERE state1 IS NOT NULL GROUP BY host),
best AS (
  SELECT conn, p.host AS best FROM phase1 p JOIN load USING (host)
  WHERE state1 <> 'Failed' AND now_s - beat1 < 172800
  QUALIFY row_number() OVER (PARTITION BY conn ORDER BY weight1 DESC, index1 + load * 3 NULLS FIRST, p.host) = 1),
ruled AS (
  SELECT p.*, CASE
    WHEN idle AND NOT open_seat THEN 'T5'
    WHEN idle AND best IS DISTINCT FROM p.host THEN 'E3'
    WHEN idle AND state1 = 'Proposed' THEN CASE WHEN reachable THEN 'E1 ok' ELSE 'E1 failed' END
    WHEN idle AND state1 = 'No' THEN 'E2'
    WHEN idle THEN 'E4'
    WHEN reports AND sane AND state1 IS NULL THEN CASE WHEN leader IS NULL THEN 'P1' ELSE 'P2' END
    WHEN reports AND sane AND state1 = 'Yes' THEN CASE
      WHEN sq = 'No' THEN 'P4' WHEN sq <> 'Yes' THEN 'P0' WHEN io = 'Yes' THEN 'P3' WHEN reachable THEN 'P5 ok' ELSE 'P5 failed' END
    WHEN reports AND sane THEN CASE state1 WHEN 'No' THEN 'P7' WHEN 'Failed' THEN 'P8' ELSE 'P9' END
    WHEN reports AND replicating THEN 'N1' END AS rule
  FROM phase1 p LEFT JOIN best USING (conn)),
phase2 AS (
  SELECT *, CASE
      WHEN rule IN ('T5', 'E3', 'P7', 'P8') THEN 'No' WHEN rule IN ('E1 ok', 'P1', 'P3', 'P5 ok', 'P9') THEN 'Yes'
      WHEN rule IN ('E1 failed', 'P4', 'P5 failed') THEN 'Failed' WHEN rule = 'E2' THEN 'Proposed'
      WHEN rule = 'N1' AND state1 IS NOT NULL THEN 'No' ELSE state1 END AS state2,
    CASE WHEN rule = 'P1' THEN nodeWeight ELSE weight1 END AS weight2,
    CASE WHEN rule IN ('T5', 'E2', 'E3', 'P1', 'P3', 'P4', 'P5 ok', 'P5 failed', 'P7', 'P8', 'P9') OR (rule = 'N1' AND state1 IS NOT NULL)
         THEN nodeIndex ELSE index1 END AS index2,
    CASE WHEN rule IN ('T5', 'E1 ok', 'E1 failed', 'E2', 'E3', 'P1', 'P3', 'P4', 'P5 ok', 'P5 failed', 'P7', 'P8', 'P9')
           OR (rule = 'N1' AND state1 IS NOT NULL) THEN now_s ELSE beat1 END AS beat2
  FROM ruled),
keeper AS (
  SELECT conn, host AS keeper, count(*) OVER (PARTITION BY conn) AS leaders FROM phase2 WHERE state2 = 'Yes' AND now_s - beat2 < 172800
  QUALIFY row_number() OVER (PARTITION BY conn ORDER BY coalesce(split_part(rule, ' ', 1) IN ('P0', 'P3', 'P5'), FALSE) DESC, index2 NULLS FIRST, host) = 1),
marked AS (
  SELECT p.*, coalesce(state2 = 'Yes' AND now_s - beat2 < 172800 AND reports AND sane AND leaders > 1 AND keeper <> p.host, FALSE) AS surplus
  FROM phase2 p LEFT JOIN keeper USING (conn)),
final AS (
  SELECT host, conn, cluster, silenced, surplus, rule AS full_rule, weight2 AS weight, state0 AS previous, now_s, updated0,
         weight0, index0, state0, beat0,
         CASE WHEN surplus THEN nodeIndex ELSE index2 END AS localIndex, CASE WHEN surplus THEN 'No' ELSE state2 END AS state,
         CASE WHEN surplus THEN now_s ELSE beat2 END AS beat,
         CASE WHEN surplus OR rule IN ('P2', 'P4', 'P5 failed', 'P7', 'P8', 'N1') THEN 'stop'
              WHEN rule IN ('E1 ok', 'P5 ok') THEN 'start' END AS action,
         nullif(concat_ws('+', CASE WHEN t1 THEN 'T1' WHEN t2 THEN 'T2' END, CASE WHEN silenced THEN 'T4' END,
                          split_part(rule, ' ', 1), CASE WHEN surplus THEN 'P6' END), '') AS rule
  FROM marked),
alert AS (
  SELECT conn AS connectionName, host, 'Slave node timeout' AS subject,
         'Node ' || host || ' is the slave but failed to report in time for the connectionName  ''' || conn || '''' AS body FROM final WHERE silenced
  UNION ALL SELECT conn, host, 'New slave', 'Node ' || host || ' is the new slave for the connectionName ''' || conn || ''''
    FROM final WHERE full_rule = 'E1 ok' AND NOT surplus
  UNION ALL SELECT conn, host, 'Failed slave', 'Node ' || host || ' failed to become the new slave for the connectionName ''' || conn || ''''
    FROM final WHERE full_rule = 'E1 failed'
  UNION ALL SELECT conn, host, 'Failed slave',
    'Node ' || host || ' failed as a slave for the connectionName ''' || conn || ''', SQL thread not running' FROM final WHERE full_rule = 'P4'
  UNION ALL SELECT conn, host, 'Failed slave', 'Node ' || host || ' failed as a slave for the cluster ' || cluster || ', IO thread not running'
    FROM final WHERE full_rule = 'P5 failed'
  UNION ALL SELECT conn, host, 'Failed slave',
    'Node ' || host || ' is not longer part of the cluster ' || cluster || ', stopping replication' FROM final WHERE full_rule = 'N1'
  UNION ALL SELECT conn, host, 'Two slaves',
    'Two nodes were slaves for the cluster ' || cluster || ', stopping slave on node ' || host FROM final WHERE surplus)
"""

_FLEET = _SIDE + _SNAP + _RULES

_STATES = """
SELECT now_s, host, conn, weight, localIndex, state, beat, previous, rule, action,
       CASE WHEN state IS NOT NULL AND (state IS DISTINCT FROM state0 OR weight IS DISTINCT FROM weight0
            OR localIndex IS DISTINCT FROM index0 OR beat IS DISTINCT FROM beat0) THEN now_s ELSE updated0 END AS updated,
       (SELECT count(*) FROM alert a WHERE a.host = f.host AND a.connectionName = f.conn) AS n_alerts
FROM final f
"""


def _fold_sql() -> str:
    """The rules applied to one snapshot after the other."""
    steps, before = ["known AS (SELECT host, conn, weight, localIndex, state, beat, updated FROM side WHERE known)"], "known"
    for day in DAYS:
        snap = f"""
          snap AS (
            SELECT * REPLACE (reports AND sane AS sane), reports AND sane AND NOT replicating AS idle FROM (
              SELECT s.host, s.conn, s.cluster, s.reports AND (s.user_id + {day}) % 5 <> 4 AS reports, s.sane, nodeIndex, nodeWeight,
                     (s.user_id * 5 + s.k + {day}) % 3 = 0 AS replicating,
                     CASE (s.user_id * 3 + s.nth * 2 + s.k + {day}) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Connecting' ELSE 'No' END AS io,
                     CASE (s.user_id + s.nth + {day}) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Connecting' END AS sq,
                     (s.user_id + s.k + {day}) % 3 = 0 OR (s.user_id + 2 * s.k + {day}) % 4 = 0 AS reachable, s.now_s + {day * 86400} AS now_s,
                     b.weight AS weight0, b.localIndex AS index0, b.state AS state0, b.beat AS beat0, b.updated AS updated0
              FROM side s LEFT JOIN {before} b ON b.host = s.host AND b.conn = s.conn)
            WHERE reports OR state0 IS NOT NULL),"""
        steps.append(f"told{day} AS MATERIALIZED (WITH {snap} {_RULES} {_STATES})")
        steps.append(f"left{day} AS (SELECT * FROM told{day} WHERE state IS NOT NULL)")
        before = f"left{day}"
    every = " UNION ALL ".join(f"SELECT * FROM told{day}" for day in DAYS)
    return f"""{_SIDE} {", ".join(steps)}
        SELECT now_s AS at, host, conn AS connectionName, weight, localIndex, state AS isSlave, updated, beat, previous, rule, action, n_alerts FROM ({every})"""


def _gap_sql(gap: int) -> str:
    return f"""
      SELECT {gap} AS gap, user_id, min(s) AS started, max(s) AS last_beat, max(s) + {gap} AS silent_from, count(*) AS beats FROM (
        SELECT user_id, s, sum(CASE WHEN s - before > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS part FROM (
          SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s,
                 lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS before FROM events))
      GROUP BY user_id, part"""


_TOPOLOGY = """
WITH node AS (
  SELECT s_suppkey, 'C' || s_nationkey AS cluster, s_nationkey, 's' || s_suppkey AS host, s_suppkey % 4 AS localIndex,
         s_suppkey % 9 <> 8 AS sane, CASE WHEN s_acctbal > 0 THEN s_suppkey % 7 + 1 ELSE 0 END AS weight
  FROM supplier),
pairs AS (
  SELECT node.*, k, 'C' || ((s_nationkey + k) % 25) AS clusterMaster,
         cluster || '-C' || ((s_nationkey + k) % 25) AS connectionName
  FROM node CROSS JOIN (VALUES (1), (2)) AS steps(k))
"""

QUERIES = {
    "links_status_rejects": (
        links_status_rejects,
        _NODES + """, told AS (SELECT user_id, CASE WHEN user_id % 7 <> 3 THEN host END AS host, CASE WHEN user_id % 11 <> 5 THEN cluster END AS cluster FROM pivoted)
                    SELECT 'h' || user_id AS host, CASE WHEN host IS NULL THEN 'no node name' ELSE 'no cluster' END AS reason
                    FROM told WHERE host IS NULL OR cluster IS NULL""",
    ),
    "links_status": (links_status, _NODES + "SELECT cluster, host, localIndex, sane FROM nodes"),
    "links_parse": (
        links_parse,
        """
        WITH e AS (
          SELECT event_id,
                 CASE event_id % 4 WHEN 0 THEN 'Waiting for master to send event' WHEN 1 THEN 'Connecting to master'
                      WHEN 2 THEN 'Reconnecting after a failed read' ELSE '' END AS io_state,
                 CASE WHEN event_id % 5 = 0 THEN '' ELSE '10.0.0.' || (user_id % 250) END AS master,
                 CASE event_id % 4 WHEN 1 THEN 'Connecting' WHEN 2 THEN 'No' ELSE 'Yes' END AS io,
                 CASE WHEN event_id % 3 = 0 THEN 'No' ELSE 'Yes' END AS sql_state
          FROM events)
        SELECT *, (io = 'Yes' AND sql_state = 'Yes' AND NOT contains(lower(io_state), 'connect'))::BIGINT AS healthy,
               (master <> '')::BIGINT AS replicating
        FROM e""",
    ),
    "links_channel": (
        links_channel,
        "SELECT DISTINCT 'h' || user_id AS host, event_type AS connectionName FROM events WHERE value > 60",
    ),
    "links_topology": (links_topology, _TOPOLOGY + "SELECT host, cluster, clusterMaster, connectionName FROM pairs"),
    "links_reach": (
        links_reach,
        """WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey % 10 AS p, s_suppkey // 10 AS g FROM supplier),
           l AS (SELECT k AS node, k - 1 AS master FROM s WHERE p BETWEEN 1 AND 7 UNION SELECT k, k + 3 FROM s WHERE p = 0 AND g % 3 = 1
                 UNION SELECT k, k - 6 FROM s WHERE p = 8 UNION SELECT k, k - 13 FROM s WHERE p = 8 AND g > 0
                 UNION SELECT k, k FROM s WHERE p = 9 AND g % 4 = 1 UNION SELECT k, k - 2 FROM s WHERE p = 9),
           n AS (SELECT node FROM l UNION SELECT master FROM l),
           r AS (SELECT node, master FROM l UNION SELECT r.node, l.master FROM r JOIN l ON r.master = l.node),
           d AS (SELECT master AS node, 0 AS depth, 'C' || master AS head FROM l WHERE master NOT IN (SELECT node FROM l)
                 UNION SELECT l.node, depth + 1, head FROM d JOIN l ON l.master = d.node WHERE depth < 30),
           b AS (SELECT node, min(depth) AS depth FROM d GROUP BY 1),
           h AS (SELECT node, depth, min(head) AS head FROM d JOIN b USING (node, depth) GROUP BY 1, 2)
           SELECT 'C' || n.node AS cluster, depth, head, EXISTS (SELECT 1 FROM r WHERE r.node = n.node AND r.master = n.node) AS in_cycle
           FROM n LEFT JOIN h ON h.node = n.node""",
    ),
    "links_weight": (links_weight, _TOPOLOGY + "SELECT cluster, host, weight FROM node"),
    "links_register": (
        links_register,
        _TOPOLOGY
        + """, known AS (
               SELECT *, CASE WHEN s_suppkey % 5 = 1 AND right(cluster, 1) < '5' THEN 'Yes' ELSE 'No' END AS isSlave
               FROM pairs WHERE k = 1 AND s_suppkey % 3 <> 0)
             SELECT host, 1 AS weight, localIndex, isSlave, epoch_us(TIMESTAMP '2024-01-30') // 1000000 AS updated,
                    epoch_us(TIMESTAMP '2024-01-30') // 1000000 AS beat, connectionName FROM known
             UNION ALL
             SELECT host, weight, localIndex, CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END,
                    epoch_us(TIMESTAMP '2024-01-31') // 1000000, epoch_us(TIMESTAMP '2024-01-31') // 1000000, connectionName
             FROM pairs p WHERE k = 1 AND s_suppkey % 3 = 0 AND sane
               AND (s_suppkey % 2 = 1 OR NOT EXISTS (SELECT 1 FROM known n WHERE n.connectionName = p.connectionName AND n.isSlave = 'Yes'))""",
    ),
    "links_led": (links_led, _REPL + "SELECT host, links FROM led"),
    "links_rank": (links_rank, _REPL + "SELECT connectionName, rank, host, weight, load FROM ranked"),
    "links_best": (links_best, _REPL + "SELECT connectionName, host AS best FROM ranked WHERE rank = 1"),
    "links_leader": (links_leader, _REPL + "SELECT connectionName, leader, age FROM leader"),
    "links_stale": (links_stale, _REPL + "SELECT connectionName, leader, age FROM leader WHERE age > 3600"),
    "links_demote": (
        links_demote,
        _REPL
        + """SELECT r.host, r.weight, r.localIndex, CASE WHEN l.leader IS NULL THEN r.isSlave ELSE 'No' END AS isSlave,
                    CASE WHEN l.leader IS NULL THEN r.updated ELSE epoch_us(TIMESTAMP '2024-01-31') // 1000000 END AS updated, r.beat, r.connectionName
             FROM repl r LEFT JOIN leader l ON l.connectionName = r.connectionName AND l.leader = r.host AND l.age > 3600""",
    ),
    "links_dup": (
        links_dup,
        _REPL
        + """SELECT connectionName, count(*) AS leaders FROM repl WHERE isSlave = 'Yes' AND age < 172800
             GROUP BY connectionName HAVING count(*) > 1""",
    ),
    "links_guard": (
        links_guard,
        _REPL
        + """SELECT connectionName, host, isSlave,
                    max(CASE WHEN isSlave = 'Proposed' AND age < 172800 THEN host END) OVER (PARTITION BY connectionName) AS proposed FROM repl""",
    ),
    "links_clear": (
        links_clear,
        _REPL
        + """SELECT host, weight, localIndex, CASE WHEN isSlave = 'Failed' AND age > 172800 THEN 'No' ELSE isSlave END AS isSlave,
                    CASE WHEN isSlave = 'Failed' AND age > 172800 THEN beat + age ELSE beat END AS updated,
                    CASE WHEN isSlave = 'Failed' AND age > 172800 THEN beat + age ELSE beat END AS beat, connectionName FROM repl""",
    ),
    "links_master": (
        links_master,
        """SELECT 'K' || (s_suppkey // 4) AS cluster, 's' || max(s_suppkey) AS master
           FROM supplier WHERE s_acctbal > 2000 AND s_suppkey % 5 <> 0 GROUP BY s_suppkey // 4""",
    ),
    "links_reconcile": (
        links_reconcile,
        _FLEET
        + """SELECT host, conn AS connectionName, weight, localIndex, state AS isSlave,
                    CASE WHEN state IS NOT NULL AND (state IS DISTINCT FROM state0 OR weight IS DISTINCT FROM weight0
                         OR localIndex IS DISTINCT FROM index0 OR beat IS DISTINCT FROM beat0) THEN now_s ELSE updated0 END AS updated,
                    beat, previous, rule, action,
                    (SELECT count(*) FROM alert a WHERE a.host = f.host AND a.connectionName = f.conn) AS n_alerts
             FROM final f""",
    ),
    "links_reconcile_stream": (links_reconcile_stream, _fold_sql()),
    "links_alerts": (links_alerts, _FLEET + "SELECT connectionName, host, subject, body FROM alert"),
    "links_gaps": (links_gaps, _gap_sql(21600) + " UNION ALL " + _gap_sql(179)),
    "links_silent": (
        links_silent,
        """SELECT user_id, event_type, epoch_us(max(ts)) // 1000000 AS last_beat,
                  epoch_us(TIMESTAMP '2024-01-31') // 1000000 - epoch_us(max(ts)) // 1000000 AS age
           FROM events GROUP BY 1, 2 HAVING age > 172800""",
    ),
}
