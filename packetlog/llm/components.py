"""Connected components of a link table by alternating large-star and
small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond).

Every step is a grouped minimum (summed up before the shuffle) and a join on the
node, which Spark splits where a hub holds many links. Steps are cut by reliable
checkpoints; the loop ends when a round leaves the links as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlog.llm import common as C


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b, distinct. Large star: a node's larger
    neighbours go to its smallest neighbour; small star: its smaller ones."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reached) for every node that
    occurs in ``links`` (two columns ``a``, ``b`` of longs, in any order)."""
    links = C.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        links = C.cut(_star(_star(links, True), False))
    # Now each node points at its component's smallest node.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
