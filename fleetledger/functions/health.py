"""Health tests of nodes and replication links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values reported by cluster nodes.
SANE_STATUS = "Primary"
SANE_STATES = (2, 4)


def is_sane(cluster_status: Column, local_state: Column) -> Column:
    """Node belongs to the primary group and is synced (4) or donor (2)."""
    sane = (cluster_status == SANE_STATUS) & local_state.try_cast("int").isin(*SANE_STATES)
    return F.coalesce(sane, F.lit(False))


def is_healthy(io_running: Column, sql_running: Column, io_state: Column) -> Column:
    """Both threads run and the IO state does not speak of connecting."""
    connecting = F.lower(F.coalesce(io_state, F.lit(""))).contains("connect")
    return F.coalesce((io_running == "Yes") & (sql_running == "Yes") & ~connecting, F.lit(False))


def is_replicating(master_host: Column) -> Column:
    return F.coalesce(master_host != "", F.lit(False))


def channel(slave: Column, master: Column) -> Column:
    """Connection name of a link."""
    return F.concat_ws("-", slave, master)
