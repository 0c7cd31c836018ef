"""Next state of every replication link from one snapshot of the fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.clock import instant, is_fresh, is_stale
from fleetledger.functions.health import is_replicating
from fleetledger.operators.links import (
    DISTRIBUTE,
    FAILED,
    NO,
    PROPOSED,
    REPL_COLUMNS,
    TIMEOUT,
    YES,
    best_candidates,
    connections,
    current_leader,
    with_weight,
)
from fleetledger.session import settle

STOP, START = "stop", "start"

# Subject and text of the alerts.
ALERTS = {
    "T4": ("Slave node timeout", "Node %s is the slave but failed to report in time for the connectionName  '%s'"),
    "E1 ok": ("New slave", "Node %s is the new slave for the connectionName '%s'"),
    "E1 failed": ("Failed slave", "Node %s failed to become the new slave for the connectionName '%s'"),
    "P4": ("Failed slave", "Node %s failed as a slave for the connectionName '%s', SQL thread not running"),
    "P5": ("Failed slave", "Node %s failed as a slave for the cluster %s, IO thread not running"),
    "P6": ("Two slaves", "Two nodes were slaves for the cluster %s, stopping slave on node %s"),
    "N1": ("Failed slave", "Node %s is not longer part of the cluster %s, stopping replication"),
}


def reconcile(
    repl: DataFrame,
    nodes: DataFrame,
    link_status: DataFrame,
    link: DataFrame,
    weight: DataFrame,
    masters: DataFrame,
    now,
    timeout: int = TIMEOUT,
    distribute: int = DISTRIBUTE,
) -> DataFrame:
    """Judge every (host, connectionName) against the same snapshot.

    ``nodes``: ``cluster, host, localIndex, sane`` of the nodes that report.
    ``link_status``: parsed status per (host, connectionName).  ``masters``: (host,
    connectionName) pairs for which a healthy master can be reached.

    Result: the columns of ``repl`` in their new state (``isSlave`` is NULL where no
    row exists), ``previous``, ``rule``, ``action`` and ``alerts``.  Rows of hosts that
    do not report stay as they are, unless they are a leader that timed out.

    The phases read each other's outcome through aggregates per host or
    connection that are joined back, so a connection with very many hosts is
    never gathered; the two ``settle`` calls keep a phase from being computed again
    for each reader.
    """
    at = instant(now)
    demoted = settle(_demote(_normalise(_rows(repl, nodes, link_status, link, weight, masters), at, timeout), repl, at, timeout))
    judged = settle(_judge(demoted, at, timeout, distribute))
    return _finish(_one_leader(judged, at, timeout), at)


def next_snapshot(reconciled: DataFrame) -> DataFrame:
    """The new state table."""
    return reconciled.where(F.col("isSlave").isNotNull()).select(*REPL_COLUMNS)


def alerts(reconciled: DataFrame) -> DataFrame:
    """One row per alert: ``connectionName, host, subject, body``."""
    return reconciled.select("connectionName", "host", F.explode("alerts").alias("a")).select(
        "connectionName", "host", "a.subject", "a.body"
    )


def _alert(kind: str, *values: str) -> Column:
    subject, body = ALERTS[kind]
    return F.struct(F.lit(subject).alias("subject"), F.format_string(body, *[F.col(v) for v in values]).alias("body"))


def _newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the largest by ``order``, then by all other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def _rows(repl, nodes, link_status, link, weight, masters) -> DataFrame:
    """State rows and reporting nodes side by side, one row per (connectionName, host)."""
    key = ["connectionName", "host"]
    # One row for each key, so that a repeated report is judged once.
    repl, link_status = _newest(repl, key, ["lastUpdate", "lastHeartbeat"]), _newest(link_status, key, [])
    nodes, weight = _newest(nodes, ["cluster", "host"], []), weight.distinct()
    pairs = with_weight(connections(nodes, link), weight).select(
        *key, "cluster", "sane", F.col("localIndex").alias("nodeIndex"), F.col("weight").alias("nodeWeight"), F.lit(True).alias("reports")
    )
    status = link_status.select(
        *key, is_replicating(F.col("Master_Host")).alias("replicating"),
        F.col("Slave_IO_Running").alias("io"), F.col("Slave_SQL_Running").alias("sql"),
    )
    reachable = masters.select(*key).distinct().withColumn("reachable", F.lit(True))
    before = repl.select(*REPL_COLUMNS)
    return (
        before.join(pairs, key, "full_outer")
        .join(status, key, "left")
        .join(reachable, key, "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("reports", "sane", "replicating", "reachable")})
        .withColumn("previous", F.col("isSlave"))
        .withColumn("_before", F.struct(*[F.col(c) for c in REPL_COLUMNS]))
    )


def _normalise(rows: DataFrame, at: Column, timeout: int) -> DataFrame:
    """T1 enters idle sane nodes; T2 lifts old failures."""
    idle = F.col("reports") & F.col("sane") & ~F.col("replicating")
    enters = idle & F.col("isSlave").isNull()
    lifted = F.coalesce(idle & (F.col("isSlave") == FAILED) & is_stale(F.col("lastUpdate"), at, 2 * timeout), F.lit(False))
    return (
        rows.withColumn("idle", idle)
        .withColumn("prelude", F.when(enters, F.lit("T1")).when(lifted, F.lit("T2")))
        .withColumns(
            {
                "isSlave": F.when(enters | lifted, F.lit(NO)).otherwise(F.col("isSlave")),
                "weight": F.when(enters, F.col("nodeWeight")).otherwise(F.col("weight")),
                "localIndex": F.when(enters | lifted, F.col("nodeIndex")).otherwise(F.col("localIndex")),
                "lastUpdate": F.when(enters | lifted, at).otherwise(F.col("lastUpdate")),
                "lastHeartbeat": F.when(enters | lifted, at).otherwise(F.col("lastHeartbeat")),
            }
        )
    )


def _demote(rows: DataFrame, repl: DataFrame, at: Column, timeout: int) -> DataFrame:
    """T4, first half: a silent leader steps down where an idle node looks at the link."""
    watched = rows.where("idle").select("connectionName").distinct().withColumn("watched", F.lit(True))
    leaders = current_leader(repl, at).join(watched, "connectionName", "left")
    timed_out = F.coalesce(F.col("age") > timeout, F.lit(False))
    steps_down = timed_out & F.col("watched").isNotNull() & (F.col("leader") == F.col("host"))
    return (
        rows.join(leaders, "connectionName", "left")
        .withColumns({"open": F.col("leader").isNull() | timed_out, "silenced": F.coalesce(steps_down, F.lit(False))})
        .withColumn("isSlave", F.when(F.col("silenced"), F.lit(NO)).otherwise(F.col("isSlave")))
    )


def _judge(rows: DataFrame, at: Column, timeout: int, distribute: int) -> DataFrame:
    """One rule per row: election or hold for idle nodes, follow-up for replicating ones."""
    existing = rows.where(F.col("isSlave").isNotNull())
    best = best_candidates(existing, at, timeout, distribute)
    state, unknown = F.col("isSlave"), F.col("isSlave").isNull()
    is_best = F.coalesce(F.col("best") == F.col("host"), F.lit(False))
    running = F.col("reports") & F.col("sane") & F.col("replicating")
    io, sql = F.coalesce("io", F.lit("")), F.coalesce("sql", F.lit(""))
    election = F.col("idle") & F.col("open")
    leads = running & (state == YES)
    broken = leads & (io != "Yes") & (sql == "Yes")
    rules = {
        "T5": F.col("idle") & ~F.col("open"),
        "E3": election & ~is_best,
        "E1 ok": election & is_best & (state == PROPOSED) & F.col("reachable"),
        "E1 failed": election & is_best & (state == PROPOSED) & ~F.col("reachable"),
        "E2": election & is_best & (state == NO),
        "E4": election & is_best & ~state.isin(PROPOSED, NO),
        "P1": running & unknown & F.col("leader").isNull(),
        "P2": running & unknown & F.col("leader").isNotNull(),
        "P3": leads & (io == "Yes") & (sql == "Yes"),
        "P4": leads & (sql == "No"),
        "P5 ok": broken & F.col("reachable"),
        "P5 failed": broken & ~F.col("reachable"),
        "P0": leads & ~sql.isin("Yes", "No"),
        "P7": running & (state == NO),
        "P8": running & (state == FAILED),
        "P9": running & (state == PROPOSED),
        "N1": F.col("reports") & ~F.col("sane") & F.col("replicating"),
    }
    fired = {name: F.coalesce(test, F.lit(False)) for name, test in rules.items()}
    hits = reduce(lambda a, b: a + b, [test.cast("int") for test in fired.values()])
    chain = reduce(lambda c, item: c.when(item[1], F.lit(item[0])), list(fired.items())[1:], F.when(fired["T5"], F.lit("T5")))
    rule = F.col("rule")
    outcome = (
        F.when(rule.isin("T5", "E3", "P7", "P8"), F.lit(NO))
        .when(rule.isin("E1 ok", "P1", "P3", "P5 ok", "P9"), F.lit(YES))
        .when(rule.isin("E1 failed", "P4", "P5 failed"), F.lit(FAILED))
        .when(rule == "E2", F.lit(PROPOSED))
        .when((rule == "N1") & F.col("isSlave").isNotNull(), F.lit(NO))
        .otherwise(F.col("isSlave"))
    )
    enters = rule == "P1"
    changes = rule.isin("T5", "E1 ok", "E1 failed", "E2", "E3", "P1", "P3", "P4", "P5 ok", "P5 failed", "P7", "P8", "P9") | (
        (rule == "N1") & F.col("isSlave").isNotNull()
    )
    # An elected node keeps the index its row has; every other change takes the node's own.
    reindexed = changes & ~rule.isin("E1 ok", "E1 failed")
    return (
        rows.join(best, "connectionName", "left")
        .withColumn("hits", hits)
        .withColumn("rule", chain)
        .withColumns(
            {
                "isSlave": outcome,
                "weight": F.when(enters, F.col("nodeWeight")).otherwise(F.col("weight")),
                "localIndex": F.when(reindexed, F.col("nodeIndex")).otherwise(F.col("localIndex")),
                "lastHeartbeat": F.when(changes, at).otherwise(F.col("lastHeartbeat")),
                "action": F.when(rule.isin("P2", "P4", "P5 failed", "P7", "P8", "N1"), F.lit(STOP)).when(
                    rule.isin("E1 ok", "P5 ok"), F.lit(START)
                ),
            }
        )
    )


def _one_leader(rows: DataFrame, at: Column, timeout: int) -> DataFrame:
    """P6: of several fresh leaders one stays: of those that led before, else of all, the lowest (localIndex, host).

    The tools that this replaces look only at leaders of before; here all are judged against one snapshot, so a node
    that the same run elected or took in can be one too many.  It then stops, with this one alert.
    """
    followed = F.coalesce(F.split_part("rule", F.lit(" "), F.lit(1)).isin("P0", "P3", "P5"), F.lit(False))
    leading = (F.col("isSlave") == YES) & is_fresh(F.col("lastHeartbeat"), at, timeout)
    keepers = (
        rows.where(leading)
        .groupBy("connectionName")
        .agg(F.count(F.lit(1)).alias("leaders"), F.min_by("host", F.struct(~followed, "localIndex", "host")).alias("keeper"))
    )
    surplus = F.coalesce(
        leading & F.col("reports") & F.col("sane") & (F.col("leaders") > 1) & (F.col("keeper") != F.col("host")), F.lit(False)
    )
    return (
        rows.join(keepers, "connectionName", "left")
        .withColumn("surplus", surplus)
        .withColumns(
            {
                "isSlave": F.when(F.col("surplus"), F.lit(NO)).otherwise(F.col("isSlave")),
                "lastHeartbeat": F.when(F.col("surplus"), at).otherwise(F.col("lastHeartbeat")),
                "localIndex": F.when(F.col("surplus"), F.col("nodeIndex")).otherwise(F.col("localIndex")),
                "action": F.when(F.col("surplus"), F.lit(STOP)).otherwise(F.col("action")),
            }
        )
    )


def _finish(rows: DataFrame, at: Column) -> DataFrame:
    rule = F.col("rule")
    raised = F.array_compact(
        F.array(
            F.when(F.col("silenced"), _alert("T4", "host", "connectionName")),
            F.when((rule == "E1 ok") & ~F.col("surplus"), _alert("E1 ok", "host", "connectionName"))
            .when(rule == "E1 failed", _alert("E1 failed", "host", "connectionName"))
            .when(rule == "P4", _alert("P4", "host", "connectionName"))
            .when(rule == "P5 failed", _alert("P5", "host", "cluster"))
            .when(rule == "N1", _alert("N1", "host", "cluster")),
            F.when(F.col("surplus"), _alert("P6", "cluster", "host")),
        )
    )
    steps = F.array_compact(
        F.array(
            F.col("prelude"),
            F.when(F.col("silenced"), F.lit("T4")),
            F.split_part(rule, F.lit(" "), F.lit(1)),
            F.when(F.col("surplus"), F.lit("P6")),
        )
    )
    before = F.col("_before")
    differs = F.lit(False)
    for name in ("isSlave", "weight", "localIndex", "lastHeartbeat"):
        differs = differs | ~F.col(name).eqNullSafe(before[name])
    touched = F.col("isSlave").isNotNull() & differs
    return rows.select(
        "host", "weight", "localIndex", "isSlave",
        F.when(touched, at).otherwise(F.col("lastUpdate")).alias("lastUpdate"),
        "lastHeartbeat", "connectionName", "previous",
        F.nullif(F.array_join(steps, "+"), F.lit("")).alias("rule"), "hits", "action", raised.alias("alerts"),
    )
