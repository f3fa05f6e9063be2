"""Packet feed: every packet in file order with the packet counter, the two
display filters, and the block-list extraction the feed is used for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import shown_interface
from ..functions.ipaddr import long_to_ip

# Limits up to this are a bounded top-n of one task; ranges of one round of ``nth_id``.
SORTED_LIMIT, ID_RANGES = 10_000, 4096

FEED_COLUMNS = ["packet_no", "iface", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action"]


def feed_filter(packets: DataFrame, no_lo: bool = False, no_accept: bool = False) -> DataFrame:
    """``no_lo`` drops packets with ``lo`` on either side; ``no_accept`` drops ACCEPT."""
    out = packets
    if no_lo:
        out = out.where((F.col("if_in") != "lo") & (F.col("if_out") != "lo"))
    if no_accept:
        out = out.where(F.col("action") != "ACCEPT")
    return out


def nth_id(packets: DataFrame, n: int) -> int | None:
    """The n-th smallest id (ids are unique), or None if there are fewer: counts
    per id range say which range holds it, the next round divides that range."""
    ends = packets.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if ends["n"] < n:
        return None
    low, high = int(ends["a"]), int(ends["b"])
    while low < high:
        width = -(-(high - low + 1) // ID_RANGES)
        inside = packets.where(F.col("id").between(low, high))
        counts = inside.groupBy(F.floor((F.col("id") - low) / F.lit(width)).alias("k")).count().orderBy("k").collect()  # at most ID_RANGES rows
        for row in counts:
            if row["count"] >= n:
                low, high = low + row["k"] * width, min(high, low + (row["k"] + 1) * width - 1)
                break
            n -= row["count"]
    return low


def scan_feed(packets: DataFrame, no_lo: bool = False, no_accept: bool = False,
              limit: int | None = None, numeric_ips: bool = False, ordered: bool = False) -> DataFrame:
    """Feed rows of a packet DataFrame (parsed log or stored table).

    ``packet_no`` is the packet's id: it counts every marker line before the
    display filters, so filtered feeds show gaps, as the original's counter.
    ``limit`` keeps the first packets in file order; a large one by the id of the
    last packet wanted, so no task holds them together (their order is then that
    of the table). ``ordered`` sorts the output by ``packet_no`` (a distributed
    range sort).
    """
    out = feed_filter(packets, no_lo, no_accept)
    if limit is not None and int(limit) > SORTED_LIMIT:
        last = nth_id(out, int(limit))
        out = out if last is None else out.where(F.col("id") <= last)
        out = out.orderBy("id") if ordered else out
    elif limit is not None:
        out = out.orderBy("id").limit(int(limit))
    elif ordered:
        out = out.orderBy("id")
    ip = (lambda c: F.col(c)) if numeric_ips else (lambda c: long_to_ip(c))
    return out.select(
        F.col("id").alias("packet_no"), shown_interface().alias("iface"),
        ip("src_ip").alias("src_ip"), "src_prt", ip("dst_ip").alias("dst_ip"), "dst_prt", "proto", "action")


def block_list(packets: DataFrame, dst_port: int = 23, proto: str = "TCP") -> DataFrame:
    """Sources that tried ``dst_port``/``proto``: packet count, first and last packet."""
    return (packets.where((F.col("dst_prt") == dst_port) & (F.col("proto") == proto))
                   .groupBy("src_ip")
                   .agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("first_packet"),
                        F.max("id").alias("last_packet"))
                   .select(long_to_ip("src_ip").alias("src_ip"), "count", "first_packet", "last_packet"))
