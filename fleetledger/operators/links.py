"""Replication links of a fleet: status, topology, candidates and guards.

``repl`` is the state table: ``host, weight, localIndex, isSlave, lastUpdate,
lastHeartbeat, connectionName`` with one row per (connectionName, host).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.clock import age_seconds, instant, is_fresh, is_stale
from fleetledger.functions.health import channel, is_healthy, is_replicating, is_sane
from fleetledger.operators.sequence import number_within

# Link states, timers, and the node values that are read.
NO, YES, PROPOSED, FAILED = "No", "Yes", "Proposed", "Failed"
TIMEOUT = 179
DISTRIBUTE = 3
NODE_VALUES = (
    "wsrep_cluster_name",
    "wsrep_node_name",
    "wsrep_local_index",
    "wsrep_cluster_status",
    "wsrep_local_state",
)
LINK_VALUES = ("Master_Host", "Slave_IO_State", "Slave_IO_Running", "Slave_SQL_Running")

# A status line; lines that mention "Last" or belong to the row banner do not count.
STATUS_LINE = r"(?m)^(?!.*Last)(?!.*\*{{4}})[ \t]*{}: (.*)$"

REPL_COLUMNS = ("host", "weight", "localIndex", "isSlave", "lastUpdate", "lastHeartbeat", "connectionName")


def pivot_status(kv: DataFrame, names: tuple[str, ...] = NODE_VALUES) -> DataFrame:
    """One row per host from ``host, name, value`` rows; only the listed names are read."""
    return (
        kv.where(F.col("name").isin(*names))
        .groupBy("host")
        .agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    )


def unplaced_nodes(status: DataFrame) -> DataFrame:
    """``host, reason`` of the nodes that :func:`nodes_from_status` cannot place: they do not name themselves, or no cluster."""
    reason = F.when(F.col("wsrep_node_name").isNull(), "no node name").when(F.col("wsrep_cluster_name").isNull(), "no cluster")
    return status.select("host", reason.alias("reason")).where(F.col("reason").isNotNull())


def nodes_from_status(status: DataFrame) -> DataFrame:
    """``cluster, host, localIndex, sane`` from pivoted node status; :func:`unplaced_nodes` has those without node name."""
    return status.where(F.col("wsrep_node_name").isNotNull()).select(
        F.col("wsrep_cluster_name").alias("cluster"),
        F.col("wsrep_node_name").alias("host"),
        F.col("wsrep_local_index").try_cast("int").alias("localIndex"),
        is_sane(F.col("wsrep_cluster_status"), F.col("wsrep_local_state")).alias("sane"),
    )


def parse_link_status(texts: DataFrame, names: tuple[str, ...] = LINK_VALUES) -> DataFrame:
    """Columns from ``Key: value`` lines in ``text``; other columns are kept.

    Lines that mention ``Last`` hold old errors and are left out.
    """
    def value(name: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(STATUS_LINE.format(name)), 1)
        return F.trim(F.try_element_at(found, F.lit(1))).alias(name)

    return texts.select(*[c for c in texts.columns if c != "text"], *[value(n) for n in names])


def channel_exists(status: DataFrame, connections: DataFrame) -> DataFrame:
    """The (host, connectionName) pairs that have a channel, by the exact name."""
    return connections.join(status.select("host", "connectionName"), ["host", "connectionName"], "left_semi")


def with_health(status: DataFrame) -> DataFrame:
    """Add ``healthy`` and ``replicating`` to parsed link status."""
    return status.withColumns(
        {
            "healthy": is_healthy(F.col("Slave_IO_Running"), F.col("Slave_SQL_Running"), F.col("Slave_IO_State")),
            "replicating": is_replicating(F.col("Master_Host")),
        }
    )


def connections(nodes: DataFrame, link: DataFrame) -> DataFrame:
    """Every link of every node: node columns plus ``clusterMaster`` and ``connectionName``."""
    return (
        nodes.join(link, F.col("cluster") == F.col("clusterSlave"))
        .withColumn("connectionName", channel(F.col("clusterSlave"), F.col("clusterMaster")))
        .drop("clusterSlave")
    )


def links_led(repl: DataFrame) -> DataFrame:
    """``host, links``: how many links each host leads."""
    return repl.groupBy("host").agg(F.count_if(F.col("isSlave") == YES).alias("links"))


def _eligible(repl: DataFrame, now, timeout: int, distribute: int) -> DataFrame:
    """Possible leaders with their ``load`` and ``standing`` (lower is better)."""
    load = links_led(repl).withColumnRenamed("links", "load")
    fresh = (F.col("isSlave") != FAILED) & is_fresh(F.col("lastHeartbeat"), now, timeout)
    return (
        repl.where(fresh)
        .select("connectionName", "host", "weight", "localIndex")
        .join(load, "host")
        .withColumn("standing", F.col("localIndex") + F.col("load") * distribute)
    )


def rank_candidates(
    repl: DataFrame, now, timeout: int = TIMEOUT, distribute: int = DISTRIBUTE, slices: int | None = None
) -> DataFrame:
    """All possible leaders of every connection, ``rank`` 1 being the best.

    Heavier weight first, then the lower local index raised by ``distribute`` for
    each link led already, then the name.  Connections of any size are ranked by
    several tasks; to know only the best, use :func:`best_candidates`.
    """
    order = [F.col("weight").desc(), F.col("standing").asc_nulls_first(), F.col("host").asc()]
    ranked = number_within(_eligible(repl, now, timeout, distribute), ["connectionName"], order, "rank", slices=slices)
    return ranked.select("connectionName", "rank", "host", "weight", "localIndex", "load")


def best_candidates(repl: DataFrame, now, timeout: int = TIMEOUT, distribute: int = DISTRIBUTE) -> DataFrame:
    """``connectionName, best``: the first-ranked host, as one aggregate."""
    order = F.struct(-F.col("weight"), F.col("standing"), F.col("host"))
    return (
        _eligible(repl, now, timeout, distribute)
        .groupBy("connectionName")
        .agg(F.min_by("host", order).alias("best"))
    )


def current_leader(repl: DataFrame, now) -> DataFrame:
    """``connectionName, leader, age``: the leading row with the lowest local index."""
    first = F.min_by(F.struct("host", "lastHeartbeat"), F.struct("localIndex", "host"))
    return (
        repl.where(F.col("isSlave") == YES)
        .groupBy("connectionName")
        .agg(first.alias("_first"))
        .select(
            "connectionName",
            F.col("_first.host").alias("leader"),
            age_seconds(F.col("_first.lastHeartbeat"), now).alias("age"),
        )
    )


def stale_leaders(repl: DataFrame, now, timeout: int = TIMEOUT) -> DataFrame:
    """Leaders that stopped reporting: they are to become ``No``, with an alert."""
    return current_leader(repl, now).where(F.col("age") > timeout)


def demote_stale(repl: DataFrame, now, timeout: int = TIMEOUT) -> DataFrame:
    """New ``repl`` with every stale leader set to ``No``."""
    gone = stale_leaders(repl, now, timeout).select("connectionName", F.col("leader").alias("host"), F.lit(True).alias("_gone"))
    hit = F.col("_gone").isNotNull()
    return repl.join(gone, ["connectionName", "host"], "left").select(
        *[
            F.when(hit, F.lit(NO)).otherwise(F.col(c)).alias(c) if c == "isSlave"
            else F.when(hit, instant(now)).otherwise(F.col(c)).alias(c) if c == "lastUpdate"
            else F.col(c)
            for c in repl.columns
        ]
    )


def with_weight(nodes: DataFrame, weight: DataFrame) -> DataFrame:
    """Add ``weight`` of each (cluster, host), 0 where none is set."""
    found = weight.select("cluster", F.col("nodename").alias("host"), F.col("weight").alias("_weight"))
    return (
        nodes.join(found, ["cluster", "host"], "left")
        .withColumn("weight", F.coalesce("_weight", F.lit(0)))
        .select(*nodes.columns, "weight")
    )


def register(pairs: DataFrame, repl: DataFrame, status: DataFrame, weight: DataFrame, now) -> DataFrame:
    """``repl`` plus rows for sane nodes it does not know yet.

    A node that replicates a link nobody leads enters as ``Yes``, one that does not
    replicate as ``No``.  A node that replicates a link led by another is not entered.
    ``pairs`` comes from :func:`connections`.
    """
    replicating = status.where(is_replicating(F.col("Master_Host"))).select(
        "host", "connectionName", F.lit(True).alias("_replicating")
    )
    led = repl.where(F.col("isSlave") == YES).select("connectionName", F.lit(True).alias("_led")).distinct()
    unseen = pairs.where("sane").join(repl.select("host", "connectionName"), ["host", "connectionName"], "left_anti")
    active = F.col("_replicating").isNotNull()
    added = (
        with_weight(unseen, weight)
        .join(replicating, ["host", "connectionName"], "left")
        .join(led, "connectionName", "left")
        .where(~active | F.col("_led").isNull())
        .select(
            "host", "weight", "localIndex", F.when(active, F.lit(YES)).otherwise(F.lit(NO)).alias("isSlave"),
            instant(now).alias("lastUpdate"), instant(now).alias("lastHeartbeat"), "connectionName",
        )
    )
    return repl.select(*REPL_COLUMNS).unionByName(added)


def live_proposal(repl: DataFrame, now, timeout: int = TIMEOUT) -> DataFrame:
    """``repl`` rows with ``proposed``: a host of the connection that holds a live proposal."""
    live = (
        repl.where((F.col("isSlave") == PROPOSED) & is_fresh(F.col("lastHeartbeat"), now, timeout))
        .groupBy("connectionName")
        .agg(F.max("host").alias("proposed"))
    )
    return repl.join(live, "connectionName", "left")


def clear_failed(repl: DataFrame, now, timeout: int = TIMEOUT) -> DataFrame:
    """New ``repl``: failures older than twice the timeout become ``No`` again."""
    over = (F.col("isSlave") == FAILED) & is_stale(F.col("lastUpdate"), now, 2 * timeout)
    moved = {"isSlave": F.lit(NO), "lastUpdate": instant(now), "lastHeartbeat": instant(now)}
    return repl.select(
        *[F.when(over, moved[c]).otherwise(F.col(c)).alias(c) if c in moved else F.col(c) for c in repl.columns]
    )


def choose_master(cluster: DataFrame, probes: DataFrame) -> DataFrame:
    """First healthy master candidate, in list order: ``cluster, master`` plus the prober if ``probes`` has one.

    ``cluster``: ``cluster, masterCandidates`` (names between blanks).  ``probes``:
    link status seen on a try of ``candidate``, optionally per ``host``.
    """
    prober = [c for c in ("host",) if c in probes.columns]
    listed = cluster.select(
        "cluster", F.posexplode(F.split(F.trim("masterCandidates"), r"\s+")).alias("place", "candidate")
    ).where(F.col("candidate") != "")
    good = probes.where(
        is_healthy(F.col("Slave_IO_Running"), F.col("Slave_SQL_Running"), F.col("Slave_IO_State"))
    ).select(*prober, "cluster", "candidate")
    return (
        listed.join(good, ["cluster", "candidate"])
        .groupBy(*prober, "cluster")
        .agg(F.min_by("candidate", "place").alias("master"))
    )


def duplicate_leaders(repl: DataFrame, now, timeout: int = TIMEOUT) -> DataFrame:
    """``connectionName, leaders`` where more than one host leads and is fresh."""
    leading = (F.col("isSlave") == YES) & is_fresh(F.col("lastHeartbeat"), now, timeout)
    return (
        repl.where(leading).groupBy("connectionName").agg(F.count(F.lit(1)).alias("leaders")).where(F.col("leaders") > 1)
    )
