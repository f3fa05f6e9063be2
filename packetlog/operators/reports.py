"""The six top-N packet reports, the shared roll-up they can all be read from,
and the full analysis.

Each report is filter -> group -> count -> order by count desc -> limit. The
plan is a partial (map-side) count, one exchange on the group keys, a final
count and a bounded top-N (``TakeOrderedAndProject``): a hot key is absorbed by
the map-side combine and never lands whole in one task. Columns that the
original query selected without grouping or aggregating (source port and
destination of R1/R4, destination of R2) are taken from the row with the lowest
id, both from the same row. Ties at the limit are cut by the group keys,
ascending (NULL first), so results are reproducible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ipaddr import long_to_ip

DEFAULT_LIMIT = 10
MAX_LIMIT = 1000


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be an integer in 1..{MAX_LIMIT}, got {limit!r}")
    return limit


def _not_lo(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) != "lo" for c in cols])


# The titles as printed. Report definitions: filter, group keys, representative columns, output order.
def _denied() -> Column:
    return (F.col("action") != "ACCEPT") & _not_lo("if_in", "if_out")


REPORTS = {
    "denied_sources": dict(
        title="Showing denied traffic grouped by IP, destination port, action taken and protocol.",
        where=_denied, keys=["src_ip", "dst_prt", "action", "proto"], rep=["src_prt", "dst_ip"],
        out=["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action"]),
    "icmp_traffic": dict(
        title="Showing ICMP traffic statistics",
        where=lambda: (F.col("proto") == "ICMP") & _not_lo("if_in", "if_out"),
        keys=["src_ip", "dst_prt", "action", "proto"], rep=["dst_ip"],
        out=["count", "src_ip", "dst_ip", "action"]),
    "denied_ports": dict(
        title="Most denied ports",
        where=_denied, keys=["dst_prt", "action", "proto"], rep=[],
        out=["count", "dst_prt", "proto", "action"]),
    "invalid_sources": dict(
        title="Most invalid packets comes from",
        where=lambda: (F.col("action") == "INVALID") & _not_lo("if_in", "if_out"),
        keys=["src_ip", "dst_prt", "proto"], rep=["src_prt", "dst_ip"],
        out=["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto"]),
    "interface_stats": dict(
        title="Interface statistics",
        where=lambda: F.col("action") != "ACCEPT", keys=["if_in", "action", "proto"], rep=[],
        out=["count", "if_in", "action", "proto"]),
    "inbound_port_actions": dict(
        title="Invalid and denied packets per port and action taken",
        where=lambda: (F.col("if_in") != "lo") & (F.col("if_in") != "") & (F.col("action") != "ACCEPT"),
        keys=["dst_prt", "action"], rep=[],
        out=["count", "dst_prt", "action"]),
}
REPORT_ORDER = list(REPORTS)

# Every filter and key column of the six reports: the roll-up grain.
ROLLUP_KEYS = ["if_in", "if_out", "src_ip", "dst_prt", "proto", "action"]
# Registers of the sketch of those keys (2^9: within 5 % in most cases, 1 KB of text in a
# log); how often a group is handled: shuffled, written, and read by each report.
SKETCH_LG, ROLLUP_PASSES = 9, 2 + len(REPORTS)


def _finish(grouped: DataFrame, spec: dict, limit: int, numeric_ips: bool,
            with_rank: bool = False) -> DataFrame:
    order = [F.col("count").desc()] + [F.col(k).asc_nulls_first() for k in spec["keys"]]
    top = grouped.orderBy(*order).limit(check_limit(limit))
    cols = []
    if with_rank:
        # The window runs over one report's top rows: at most MAX_LIMIT of them.
        from pyspark.sql import Window
        cols.append(F.row_number().over(Window.orderBy(*order)).alias("rank"))
    for c in spec["out"]:
        col = F.col(c)
        if c in ("src_ip", "dst_ip") and not numeric_ips:
            col = long_to_ip(col)
        cols.append(col.alias(c))
    return top.select(*cols)


def report(logs: DataFrame, name: str, limit: int = DEFAULT_LIMIT, numeric_ips: bool = False,
           where: Column | None = None, with_rank: bool = False) -> DataFrame:
    """One report straight from the packet table.

    ``where`` replaces the hard-coded filter (the original never made it
    configurable); ``numeric_ips`` keeps addresses as numbers (for joins).
    """
    spec = REPORTS[name]
    cond = spec["where"]() if where is None else where
    # One min_by per column keeps the buffers fixed-width (hash aggregation);
    # ids are unique, so all of them come from the same row.
    aggs = [F.count(F.lit(1)).alias("count")] + [F.min_by(c, "id").alias(c) for c in spec["rep"]]
    grouped = logs.where(cond).groupBy(*spec["keys"]).agg(*aggs)
    return _finish(grouped, spec, limit, numeric_ips, with_rank)


def packet_rollup(logs: DataFrame) -> DataFrame:
    """Counts per (if_in, if_out, src_ip, dst_prt, proto, action) with the
    lowest id and that row's source port and destination."""
    return logs.groupBy(*ROLLUP_KEYS).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("id").alias("min_id"),
        F.min_by("src_prt", "id").alias("src_prt"),
        F.min_by("dst_ip", "id").alias("dst_ip"))


def _in_reports() -> Column:
    # Accepted packets other than ICMP are in no report.
    return (F.col("action") != "ACCEPT") | (F.col("proto") == "ICMP")


def rollup_facts() -> list[Column]:
    """Aggregates that tell how far a roll-up shrinks the packets: their number, that
    of those in reports, and a mergeable distinct-count sketch of their keys (text)."""
    keys = F.when(_in_reports(), F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in ROLLUP_KEYS]))
    return [F.count(F.lit(1)).alias("packets"), F.count_if(_in_reports()).alias("reported"),
            F.base64(F.hll_sketch_agg(keys, SKETCH_LG)).alias("sketch")]


def merge_facts(spark: SparkSession, a: dict, b: dict) -> dict:
    """Facts about the packets of two tables together."""
    union = F.base64(F.hll_union(F.unbase64(F.lit(a["sketch"])), F.unbase64(F.lit(b["sketch"]))))
    return {"packets": a["packets"] + b["packets"], "reported": a["reported"] + b["reported"],
            "sketch": spark.range(1).select(union).first()[0]}


def rollup_groups(spark: SparkSession, facts: dict) -> int:
    """Estimated rows of the roll-up."""
    return spark.range(1).select(F.hll_sketch_estimate(F.unbase64(F.lit(facts["sketch"])))).first()[0]


def rollup_pays(spark: SparkSession, facts: dict) -> bool:
    """Whether six reports by way of a roll-up handle fewer rows than six scans: one
    scan, its groups shuffled, written and read six times."""
    if not facts["reported"]:
        return True
    return facts["packets"] + ROLLUP_PASSES * rollup_groups(spark, facts) <= len(REPORTS) * facts["packets"]


def report_rollup(logs: DataFrame) -> DataFrame:
    """The roll-up of all packets that are in any report (accepted ones other than
    ICMP are in none)."""
    return packet_rollup(logs.where(_in_reports()))


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """One row per key from the roll-ups of several parts of a table."""
    return rollups.groupBy(*ROLLUP_KEYS).agg(
        F.sum("count").alias("count"), F.min("min_id").alias("_least"),
        F.min_by("src_prt", "min_id").alias("src_prt"),
        F.min_by("dst_ip", "min_id").alias("dst_ip")).withColumnRenamed("_least", "min_id")


def report_from_rollup(rollup: DataFrame, name: str, limit: int = DEFAULT_LIMIT,
                       numeric_ips: bool = False, with_rank: bool = False) -> DataFrame:
    """The same report computed from the roll-up (sum of counts, representative
    of the smallest ``min_id``)."""
    spec = REPORTS[name]
    aggs = [F.sum("count").cast("bigint").alias("count")] + [F.min_by(c, "min_id").alias(c) for c in spec["rep"]]
    grouped = rollup.where(spec["where"]()).groupBy(*spec["keys"]).agg(*aggs)
    return _finish(grouped, spec, limit, numeric_ips, with_rank)


# Names of the six reports as functions (the original's analysis order).
def denied_sources(logs, limit=DEFAULT_LIMIT, **kw):
    return report(logs, "denied_sources", limit, **kw)


def icmp_traffic(logs, limit=DEFAULT_LIMIT, **kw):
    return report(logs, "icmp_traffic", limit, **kw)


def denied_ports(logs, limit=DEFAULT_LIMIT, **kw):
    return report(logs, "denied_ports", limit, **kw)


def invalid_sources(logs, limit=DEFAULT_LIMIT, **kw):
    return report(logs, "invalid_sources", limit, **kw)


def interface_stats(logs, limit=DEFAULT_LIMIT, **kw):
    return report(logs, "interface_stats", limit, **kw)


def inbound_port_actions(logs, limit=DEFAULT_LIMIT, **kw):
    return report(logs, "inbound_port_actions", limit, **kw)


ALL_COLUMNS = ["report", "rank", "count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action", "if_in"]


def analysis(logs: DataFrame, limit: int = DEFAULT_LIMIT, use_rollup: bool | str = True,
             numeric_ips: bool = False, with_rank: bool = False) -> dict[str, DataFrame]:
    """All six reports, in the original order. With ``use_rollup`` (or ``"auto"``, if a
    sketch of the keys, taken in one scan without a shuffle, says it pays) they are
    read from one shared roll-up, written once to the checkpoint folder: the
    packet table is scanned and shuffled once instead of six times. (Left lazy,
    Catalyst would push each report's filter below the roll-up and plan six
    different scans.)"""
    if use_rollup == "auto":
        use_rollup = rollup_pays(logs.sparkSession, logs.agg(*rollup_facts()).first().asDict())
    if use_rollup:
        rollup = report_rollup(logs).checkpoint(eager=True)
        return analysis_from_rollup(rollup, limit, numeric_ips, with_rank)
    return {n: report(logs, n, limit, numeric_ips=numeric_ips, with_rank=with_rank) for n in REPORT_ORDER}


def analysis_from_rollup(rollup: DataFrame, limit: int = DEFAULT_LIMIT, numeric_ips: bool = False,
                         with_rank: bool = False) -> dict[str, DataFrame]:
    """All six reports from a stored roll-up (or those of several imports, not merged)."""
    return {n: report_from_rollup(rollup, n, limit, numeric_ips, with_rank) for n in REPORT_ORDER}


def analysis_union(logs: DataFrame, limit: int = DEFAULT_LIMIT, use_rollup: bool = True) -> DataFrame:
    """The six result sets as one DataFrame: ``report`` names the set, ``rank``
    is the position inside it, absent columns are NULL."""
    return union_reports(analysis(logs, limit, use_rollup, with_rank=True))


def union_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports made ``with_rank`` as one DataFrame."""
    parts = []
    for name, df in reports.items():
        cols = []
        for c in ALL_COLUMNS:
            if c == "report":
                cols.append(F.lit(name).alias("report"))
            elif c in df.columns:
                cols.append(F.col(c))
            else:
                t = {"src_prt": "bigint", "dst_prt": "bigint", "count": "bigint", "rank": "int"}.get(c, "string")
                cols.append(F.lit(None).cast(t).alias(c))
        parts.append(df.select(*cols))
    return reduce(DataFrame.unionByName, parts)
