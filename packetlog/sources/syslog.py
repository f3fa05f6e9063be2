"""Syslog text source (batch)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the marker every packet-log line carries.
MARKER = "IPT: "

# Columns that locate a line inside the input: the entry of the list of paths, the
# file, then the split (block) of that file.
ORDER_COLUMNS = ("file_entry", "file_path", "file_block_start")

# Rotated names: a number of up to three digits behind a dot counts backwards (fw.log.2
# is older than fw.log.1), a date behind a dot or dash forwards; the plain name is newest.
_PACKED = r"\.(gz|bz2|xz|zst|lz4|deflate)$"
_NUMBER, _DATE = r"\.(\d{1,3})$", r"[.-](\d{6,14})$"


def rotation(path: Column) -> tuple[Column, Column]:
    """A file's name without what rotation added, and its place among the files of
    that name, oldest first."""
    plain = F.regexp_replace(path, _PACKED, "")
    number, date = F.regexp_extract(plain, _NUMBER, 1), F.regexp_extract(plain, _DATE, 1)
    base = F.when(number != "", F.regexp_replace(plain, _NUMBER, "")).otherwise(F.regexp_replace(plain, _DATE, ""))
    newest = F.lit(1 << 60)
    turn = F.when(number != "", -F.try_to_number(number, F.lit("999")).cast("long")).when(date != "", date.try_cast("long")).otherwise(newest)
    return base, turn


def file_order(order_cols) -> list[Column]:
    """Sort columns of ``order_cols``: entries as given, the files of an entry by name
    and rotation, splits from the front."""
    out: list[Column] = []
    for c in order_cols:
        out += [*rotation(F.col(c)), F.col(c)] if c == "file_path" else [F.col(c)]
    return out


def read_syslog(spark: SparkSession, paths, modified_after=None) -> DataFrame:
    """Every line of the given files (paths, directories, globs; ``.gz``
    rotations are read transparently). Columns: ``value``, ``file_entry`` (place in
    the list of paths), ``file_path``, ``file_block_start``,
    ``file_modification_time``. The order of the lines is that of the list, inside a
    directory or glob that of the rotation, oldest first. An entry that is listed
    twice is read twice.

    ``modified_after`` keeps only files changed after that time (the "start at
    the end" of a live feed, applied per file).
    """
    entries = [paths] if isinstance(paths, str) else list(paths)
    df = reduce(DataFrame.unionByName, [_read_entry(spark, p, k) for k, p in enumerate(entries)])
    if modified_after is not None:
        df = df.where(F.col("file_modification_time") > F.lit(modified_after))
    return df


def _read_entry(spark: SparkSession, path: str, entry: int) -> DataFrame:
    # A line ends at LF only; one CR before it is not part of the line.
    return spark.read.text(path, lineSep="\n").select(
        without_cr("value").alias("value"),
        F.lit(entry).alias("file_entry"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.col("_metadata.file_modification_time").alias("file_modification_time"),
    )


def without_cr(column: str) -> Column:
    c = F.col(column)
    return F.when(c.endswith("\r"), F.left(c, F.length(c) - 1)).otherwise(c)


def marker_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines containing the marker substring (cheap test, pushed to the scan)."""
    return lines.where(F.col(value).contains(MARKER))
