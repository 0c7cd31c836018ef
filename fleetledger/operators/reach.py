"""The whole topology of replicating clusters: who replicates from whom over any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.session import settle


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _nearest_heads(edges: DataFrame) -> DataFrame:
    """``node, depth, head`` of all nodes that a head reaches, breadth first; links into what is reached drop out."""
    masters, below = edges.select(F.col("master").alias("node")), edges.select(F.col("node"))
    frontier = settle(masters.join(below, "node", "left_anti").distinct().select("node", F.lit(0).alias("depth"), F.col("node").alias("head")))
    reached, left = frontier, edges
    while _some(frontier):
        arrived = left.join(frontier.select(F.col("node").alias("master"), "depth", "head"), "master")
        frontier = settle(arrived.groupBy("node").agg((F.min("depth") + 1).alias("depth"), F.min("head").alias("head")))
        left = settle(left.join(frontier, "node", "left_anti"))
        reached = settle(reached.unionByName(frontier))
    return reached


def _trimmed(edges: DataFrame) -> DataFrame:
    """Links without those that no cycle can use: their master replicates from nobody, or nobody from their node."""
    before, edges = -1, settle(edges)
    while (now := edges.count()) != before:
        into, out = edges.select(F.col("node").alias("master")), edges.select(F.col("master").alias("node"))
        before, edges = now, settle(edges.join(into, "master", "left_semi").join(out, "node", "left_semi"))
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """``node, colour``: the greatest node that reaches each node, itself included."""
    nodes = edges.select("node").union(edges.select("master")).distinct()
    colours, changed = settle(nodes.withColumn("colour", F.col("node"))), True
    while changed:
        given = edges.join(colours.select(F.col("node").alias("master"), "colour"), "master").groupBy("node").agg(F.max("colour").alias("given"))
        brighter = settle(colours.join(given, "node", "left").select("node", F.greatest("colour", "given").alias("colour"), (F.col("given") > F.col("colour")).alias("_new")))
        changed, colours = _some(brighter.where("_new")), brighter.drop("_new")
    return colours


def _on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle.

    Nodes of one cycle have one colour, and lead back to the node that gave it.  Those are found colour by colour at once; what
    is left without them and without links between colours has fewer colours' worth of links each time.
    """
    found, left = settle(edges.select("node").limit(0)), _trimmed(edges)
    while _some(left):
        colours = _coloured(left)
        of_node = left.join(colours.withColumnRenamed("colour", "_own"), "node")
        inside = settle(of_node.join(colours.select(F.col("node").alias("master"), "colour"), "master").where("colour = _own").select("master", "node", "colour"))
        members = settle(inside.where("node = colour").select("node").distinct())
        frontier = members
        while _some(frontier):
            behind = inside.join(frontier, "node", "left_semi").select(F.col("master").alias("node")).distinct()
            frontier = settle(behind.join(members, "node", "left_anti"))
            members = settle(members.unionByName(frontier))
        found = settle(found.unionByName(members))
        off = inside.select("master", "node").join(members, "node", "left_anti").join(members.select(F.col("node").alias("master")), "master", "left_anti")
        left = _trimmed(off)
    return found


def reach(link: DataFrame) -> DataFrame:
    """``cluster, depth, head, in_cycle`` of every cluster that ``link`` (``clusterSlave, clusterMaster``) names.

    A head replicates from nobody.  ``depth`` is the fewest links to a head, ``head`` the nearest (of equally near ones the
    smallest); both are NULL where only cycles lead to a cluster.  ``in_cycle`` tells whether a cluster gets its own changes
    back.  Links with a NULL end do not count; repeated links count once.

    Breadth first over all heads at once: a round is one join for each step of depth, and every table is cut to what is
    still open.  Nothing is collected but whether a round found something.
    """
    edges = settle(link.select(F.col("clusterMaster").alias("master"), F.col("clusterSlave").alias("node")).dropna().distinct())
    nodes = edges.select("node").union(edges.select("master")).distinct()
    cycles = _on_cycles(edges).withColumn("in_cycle", F.lit(True))
    known = nodes.join(_nearest_heads(edges), "node", "left").join(cycles, "node", "left")
    return known.select(F.col("node").alias("cluster"), "depth", "head", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
