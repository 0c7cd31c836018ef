"""Connected components of any graph of long ids, by alternating large and small stars.

Each round links nodes to the smallest neighbour they know; rounds grow with the logarithm of a
component's size, not with its diameter.  Minima are combined before the shuffle, a hub of any size is
split by adaptive execution, and each round is stored reliably, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.session import settle


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest id of its component) of every node of ``edges`` (a, b); pairs of equal ids give nothing."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = settle(links), None
    while True:
        links = settle(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
