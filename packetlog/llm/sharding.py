"""Sharding by a hierarchical weighted hash tree (operator 6).

Shards are leaves of a tree of regions and racks. A document descends from the
root: at each level every child draws -ln(u) / weight with u a hash of
(doc_id, child), and the smallest draw wins. Children are hit in proportion to
their weights (the sum of the shards below), and a changed weight moves rows
only into or out of the subtrees whose weights change. The work per row is the
number of children on its way, not the number of shards.

A further shard (``grow``) joins as a subtree of its own, a region with one
rack, so no other subtree's weight changes: rows only move into it. The law is
``key``: the id and the tree decide, nothing else.

Slots number a shard's rows from 0 without gaps, in (doc_id, crc32, size) order.
Rows are dealt by ranges of that order with a row number as the last key, so
neither a shard nor a repeated id is ever one task's work; a small table of
(range, shard) counts gives each range its first slots.

Edge cases: a null id is a key of its own (all such rows share a shard); a null
text has size 8 and crc32 0; repeated rows share the shard but not the slot; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlog.llm import common as C

SHARDS = 24
REGIONS, RACKS = 3, 2
EXTRA_BYTES = 8
#: A shard's weight may be 1/1000 of another's; draws are 53-bit fractions.
HASH_BITS = 53


class Shard(NamedTuple):
    """A leaf of the tree."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def default_tree(shards: int = SHARDS) -> list[Shard]:
    """``shards`` equal shards over three regions of two racks each."""
    groups = REGIONS * RACKS
    return [Shard(k, f"region{k % groups % REGIONS}", f"rack{k % groups}") for k in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    new = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(new, f"region+{new}", f"rack+{new}", weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 64 - HASH_BITS).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))) / F.lit(float(weight))


def _choose(key: Column, children: list[tuple[str, float]]) -> Column:
    """The child with the smallest draw (of equal draws, the first in order)."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("draw"), F.lit(n).alias("node")) for n, w in sorted(children)]))["node"]


def _weights(tree: list[Shard]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children (node, weight) of every node above."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        path = ("", s.region, f"{s.region}/{s.rack}", str(s.shard))
        for k in range(3):
            below = levels[k].setdefault(path[k], {})
            below[path[k + 1]] = below.get(path[k + 1], 0.0) + s.weight
    return [{n: list(below.items()) for n, below in level.items()} for level in levels]


def descend(rows: DataFrame, tree: list[Shard], key: str, to: str) -> DataFrame:
    """``rows`` with the shard that each ``key`` descends to as column ``to``,
    one level after the other. Only positive weights take part."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard of positive weight")
    if len({s.shard for s in live}) < len(live):
        raise ValueError("shard numbers must differ")
    node = "__node_" + to
    rows = rows.withColumn(node, F.lit(""))
    for level in _weights(live):
        chosen = None
        for above, children in sorted(level.items()):
            one = _choose(F.col(key), children)
            chosen = F.when(F.col(node) == above, one) if chosen is None else chosen.when(F.col(node) == above, one)
        rows = rows.withColumn(node, chosen)
    return rows.withColumn(to, F.col(node).cast("int")).drop(node)


def assign(docs: DataFrame, tree: list[Shard] | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``grown_shard``, ``slot``."""
    tree = tree or default_tree()
    text = F.coalesce(F.col(C.TEXT).cast("string"), F.lit(""))
    key = F.coalesce(F.col(C.DOC_ID).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(C.DOC_ID).alias("doc_id"), (F.octet_length(text) + F.lit(EXTRA_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = descend(descend(rows, tree, "key", "shard"), grow(tree), "key", "grown_shard").drop("key")
    order = ["doc_id", "text_crc32", "size", "row"]
    # The checkpoint fixes which range each row is in.
    dealt = C.cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)) - 1
    return (dealt.withColumn("place", place).join(first, ["part", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("first") + F.col("place")).cast("long").alias("slot")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
