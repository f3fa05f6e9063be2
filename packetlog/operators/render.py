"""Fixed-width text of reports and feed lines, as the original printed them.

Rows become text with ``format_string`` on the executors; only printing a
bounded page (``print_*``) touches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import REPORTS

# Per-report column headers and row formats of the original output.
REPORT_TEXT = {
    "denied_sources": (
        [" Count Source IP                 SPort Dest IP                   DPort Proto  Action",
         "------ ------------------------- ----- ------------------------- ----- ------ ----------"],
        "%6d %-25s %5d %-25s %5d %-6s %-10s",
        ["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action"]),
    "icmp_traffic": (
        [" Count Source IP                 Dest IP                   Action    ",
         "------ ------------------------- ------------------------- ----------"],
        "%6d %-25s %-25s %-10s",
        ["count", "src_ip", "dst_ip", "action"]),
    "denied_ports": (
        [" Count   DPort   Proto    Action       ",
         "------   -----   ------   ----------   "],
        "%6d    %5d   %-6s   %-10s",
        ["count", "dst_prt", "proto", "action"]),
    "invalid_sources": (
        [" Count   Source IP                   SPort   Dest IP                     DPort   Proto    ",
         "------   -------------------------   -----   -------------------------   -----   ------   "],
        "%6d   %-25s   %5d   %-25s   %5d   %-6s   ",
        ["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto"]),
    "interface_stats": (
        [" Count   IF In        Action       Proto",
         "------   ----------   ----------   -----"],
        "%6d   %-10s   %-10s   %-6s   ",
        ["count", "if_in", "action", "proto"]),
    "inbound_port_actions": (
        [" Count   DPort   Action",
         "------   -----   ----------"],
        "%6d   %5d   %-10s   ",
        ["count", "dst_prt", "action"]),
}

# Feed headers and row formats (with and without the counter).
FEED_HEADER = [
    "Time     Count    IF       Source                          Port Destination                     Port Proto      Action    ",
    "-------- -------- -------- ------------------------------ ----- ------------------------------ ----- ---------- ----------",
]
FEED_HEADER_NO_COUNT = [
    "Time     IF       Source                          Port Destination                     Port Proto      Action    ",
    "-------- -------- ------------------------------ ----- ------------------------------ ----- ---------- ----------",
]
FEED_FORMAT = "%8d %-8s %-30s %5d %-30s %5d %-10s %-10s"
FEED_FORMAT_NO_COUNT = "%-8s %-30s %5d %-30s %5d %-10s %-10s"
HEADER_EVERY = 20


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint")


def report_text(report: DataFrame, name: str, names: dict[str, str] | None = None) -> DataFrame:
    """One ``line`` per report row. ``names`` maps an address column to a
    column with its display name (e.g. ``{"src_ip": "src_ip_name"}``)."""
    _, fmt, cols = REPORT_TEXT[name]
    names = names or {}
    args = []
    for c in cols:
        if c in ("count", "src_prt", "dst_prt"):
            args.append(_n(c))
        else:
            args.append(_s(names.get(c, c)))
    keep = [c for c in ("rank",) if c in report.columns]
    return report.select(*keep, F.format_string(fmt, *args).alias("line"))


def report_header(name: str) -> list[str]:
    return ["", REPORTS[name]["title"], *REPORT_TEXT[name][0]]


def feed_text(feed: DataFrame, counter: bool = True, clock: str | None = None,
              names: dict[str, str] | None = None) -> DataFrame:
    """One ``line`` per feed row; ``clock`` names a timestamp column printed
    as HH:MM:SS in front (the arrival time of a live feed)."""
    names = names or {}
    args = [_s("iface"), _s(names.get("src_ip", "src_ip")), _n("src_prt"),
            _s(names.get("dst_ip", "dst_ip")), _n("dst_prt"), _s("proto"), _s("action")]
    if counter:
        line = F.format_string(FEED_FORMAT, _n("packet_no"), *args)
    else:
        line = F.format_string(FEED_FORMAT_NO_COUNT, *args)
    if clock:
        line = F.concat(F.date_format(clock, "HH:mm:ss"), F.lit(" "), line)
    return feed.select("packet_no", line.alias("line"))


def with_headers(lines: list[str], header: list[str], every: int = HEADER_EVERY) -> list[str]:
    """Insert a blank line and ``header`` before every ``every`` lines."""
    out = []
    for i, line in enumerate(lines):
        if i % every == 0:
            out += ["", *header]
        out.append(line)
    return out


def print_report(report: DataFrame, name: str, names: dict[str, str] | None = None) -> list[str]:
    """Render a report (at most 1000 rows by construction) and print it."""
    text = report_text(report, name, names)
    order = ["rank"] if "rank" in text.columns else []
    rows = [r["line"] for r in (text.orderBy(*order) if order else text).collect()]
    out = report_header(name) + rows
    print("\n".join(out))
    return out


def feed_lines(feed: DataFrame, counter: bool = True, header: bool = True, clock: str | None = None,
               names: dict[str, str] | None = None) -> DataFrame:
    """The whole printed feed as rows: ``line_no`` (position among the printed
    packets, from 1), ``packet_no`` and ``line``; every ``HEADER_EVERY``-th line
    carries the header in front of it. A distributed numbering: packets are
    ranged by number, a small table of range sizes gives each range its start."""
    text = feed_text(feed, counter, clock, names)
    ranged = text.repartitionByRange("packet_no").withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("packet_no"))
    out = ranged.withColumn("_place", place).join(starts, "_part").select((F.col("_start") + F.col("_place")).alias("line_no"), "packet_no", "line")
    if header:
        top = "\n".join(["", *feed_header(counter, clock), ""])
        out = out.withColumn("line", F.when((F.col("line_no") - 1) % HEADER_EVERY == 0, F.concat(F.lit(top), F.col("line"))).otherwise(F.col("line")))
    return out


def write_feed(feed: DataFrame, path: str, **options) -> None:
    """Write the whole printed feed as text files in feed order."""
    feed_lines(feed, **options).sort("line_no").select("line").write.text(path)


def feed_header(counter: bool = True, clock: str | None = None) -> list[str]:
    rows = FEED_HEADER if counter else FEED_HEADER_NO_COUNT
    return rows if clock else [h[9:] for h in rows]


def print_feed(feed: DataFrame, max_lines: int | None = None, counter: bool = True, header: bool = True,
               clock: str | None = None, names: dict[str, str] | None = None) -> list[str]:
    """Print the feed with the repeating header: all of it, partition by
    partition, or its first ``max_lines`` packets. Returns the printed lines of
    a bounded page, and nothing for a whole feed."""
    text = feed_text(feed, counter, clock, names).orderBy("packet_no")
    rows = text.toLocalIterator() if max_lines is None else text.limit(max_lines).collect()
    top, out = feed_header(counter, clock) if header else [], []
    for i, row in enumerate(rows):
        lines = [*(["", *top] if header and i % HEADER_EVERY == 0 else []), row["line"]]
        print("\n".join(lines))
        if max_lines is not None:
            out += lines
    return out
