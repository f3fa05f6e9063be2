"""Log text -> packet rows: marker test, file-order ids, parse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import number_rows
from ..operators.parse import parse_lines, packets, rejects
from ..operators.years import ANY_YEAR, years_by_order
from ..session import jit_sized_codegen, scratch_path
from ..sources.syslog import marker_lines, MARKER, ORDER_COLUMNS


def stage_lines(lines: DataFrame, path: str, year=None, keep_lines: bool = False) -> DataFrame:
    """Parse the log in one text scan and write the compact result to ``path``:
    packet columns, ``ok``, the raw line (of rejects only, unless
    ``keep_lines``), and the position columns (file, split, sequence taken in
    that same scan) from which ids are derived. ``year`` is that of ``parse_lines``, or
    ``"order"``: years by the order of the lines (``years_by_order``), filled in by
    ``number_staged``. Returns the staged table.

    Recording positions in the scan that parses makes the ids independent of
    how a later job would split the files (split sizes follow the number of
    cores, which changes when executors come and go)."""
    marked = marker_lines(lines).withColumn("_seq", F.monotonically_increasing_id())
    keep = (*ORDER_COLUMNS, "_seq", "value")
    by_order = isinstance(year, str) and year == "order"
    if by_order or isinstance(year, str) and year == "auto":
        keep += ("file_modification_time",)
    parsed = parse_lines(marked, year=ANY_YEAR if by_order else year, keep=keep)
    if not by_order and "file_modification_time" in parsed.columns:
        parsed = parsed.drop("file_modification_time")
    if not keep_lines:
        parsed = parsed.withColumn("value", F.when(~F.col("ok"), F.col("value")))
    with jit_sized_codegen(lines.sparkSession):
        parsed.write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path)


def number_staged(staged: DataFrame, base=0, with_total: bool = False, offsets_path: str | None = None):
    """Ids for a staged table (its position columns, no second text scan), and years
    for one that was staged with ``year="order"``."""
    if "file_modification_time" in staged.columns:
        staged = years_by_order(staged, offsets_path and offsets_path + "/years")
    out = number_rows(staged, "id", base=base, seq_col="_seq", with_total=with_total, offsets_path=offsets_path)
    if with_total:
        return out[0].drop(*ORDER_COLUMNS), out[1]
    return out.drop(*ORDER_COLUMNS)


def parse_log(lines: DataFrame, year=None, base=0, with_total: bool = False,
              staging: str | None = None, keep_lines: bool = False):
    """Marker lines of ``lines`` (from ``read_syslog``), numbered in file order
    (``id``, 1-based over marker lines, continuing after ``base``) and parsed.

    The text is scanned once: parsed rows are staged (Parquet under
    ``staging``, default a new folder in the shared scratch area) and the
    result reads them back. Columns: packet columns, ``ok`` and ``value`` (the
    raw line of rejects; of every line with ``keep_lines``). With
    ``with_total`` also the number of marker lines is returned."""
    path = staging or scratch_path(lines.sparkSession, "staging", uuid.uuid4().hex)
    staged = stage_lines(lines, path + "/rows", year, keep_lines)
    return number_staged(staged, base, with_total, offsets_path=path + "/offsets")


def packets_from_log(lines: DataFrame, year=None, base=0) -> DataFrame:
    """Packet rows of a log (accepted lines only, packet-table columns)."""
    return packets(parse_log(lines, year, base))


def import_summary(lines: DataFrame) -> DataFrame:
    """Counts of one import in one pass: lines read, lines with the marker,
    parsed packets, rejected lines."""
    from ..operators.parse import parse_columns
    v = F.col("value")
    has_marker = v.contains(MARKER)
    ok = parse_columns(v)["ok"]
    return lines.agg(
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if(has_marker).alias("marker_lines"),
        F.count_if(has_marker & ok).alias("parsed"),
        F.count_if(has_marker & ~ok).alias("rejected"),
    )


__all__ = ["parse_log", "packets_from_log", "import_summary", "rejects"]
