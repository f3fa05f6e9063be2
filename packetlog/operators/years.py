"""Years of a syslog by the order of its lines.

Syslog lines carry no year. In a log that is in order, a step from a late month to an
early one is a new year; the last line lies in the last year that doesn't put it behind
the file's modification time. So each line's year is the last line's, less the new years
that follow it. The files of one entry of the list of paths, in file order, are one log
(list different logs as different entries).

Months are compared by their distance round the year: up to six months ahead is
forward, else back. A line that comes late, from December among those of January,
steps back a year and the next one forth again.

Only the month column is read to find the steps. Runs of ``RUN`` neighbouring lines
are reduced to one point before the shuffle if they lie in one month (most do); of the
others every line is a point. Steps are found per split and summed over one row per
split (two million of those are some 250 TiB of text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.syslog import ORDER_COLUMNS, file_order

#: A leap year, in which every day of a log exists.
ANY_YEAR = 2000
RUN = 8192
#: Tables of splits and steps up to these sizes are broadcast, larger ones are shuffled.
MAX_BROADCAST_ROWS = 1_000_000
#: How far back a last line of 29 February may have to look for its year.
_LOOK_BACK = 8


def _new_years(before: Column, month: Column) -> Column:
    """New years between neighbouring months: 1, 0, or -1 for a step back."""
    ahead = F.pmod(month - before, F.lit(12)) <= 6
    return F.when(ahead & (month < before), 1).when(~ahead & (month > before), -1).otherwise(0)


def in_year(time: Column, year: Column) -> Column:
    """``time`` in another year; NULL where that has no such day."""
    second = F.extract(F.lit("SECOND"), time)
    return F.try_make_timestamp_ntz(year.cast("int"), F.month(time), F.dayofmonth(time), F.hour(time), F.minute(time), second)


def _last_year(time: Column, modified: Column, tolerance_hours: int) -> Column:
    latest = modified + F.make_dt_interval(F.lit(0), F.lit(tolerance_hours))
    years = F.sequence(F.year(latest), F.year(latest) - _LOOK_BACK, F.lit(-1))
    return F.get(F.filter(years, lambda y: in_year(time, y) <= latest), F.lit(0))


def years_by_order(staged: DataFrame, path: str | None = None, tolerance_hours: int = 24) -> DataFrame:
    """``staged`` (see ``stage_lines``: position columns, ``_seq``, ``timestamp`` in
    ``ANY_YEAR`` and ``file_modification_time``) with the years of its times. Times
    that are NULL stay so. ``path`` takes the table of splits (default: a new folder
    in the scratch area)."""
    spark = staged.sparkSession
    path = path or scratch_path(spark, "staging", "years-" + uuid.uuid4().hex)
    split = list(ORDER_COLUMNS)
    lines = staged.where(F.col("timestamp").isNotNull()).select(
        *split, "_seq", F.month("timestamp").alias("_month"), F.floor(F.col("_seq") / RUN).alias("_run"), "timestamp", "file_modification_time")
    runs = lines.groupBy(*split, "_run").agg(
        F.min("_seq").alias("_seq"), F.min("_month").alias("_month"), F.max("_month").alias("_most"),
        F.max("file_modification_time").alias("_modified"), F.max_by("timestamp", "_seq").alias("_time"))
    runs.write.mode("overwrite").parquet(path + "/runs")
    runs = spark.read.parquet(path + "/runs")
    mixed = runs.where("_month <> _most").select(*split, "_run")
    n_mixed = mixed.count()
    points = runs.where("_month = _most").select(*split, "_seq", "_month")
    if n_mixed:
        chosen = F.broadcast(mixed) if n_mixed <= MAX_BROADCAST_ROWS else mixed
        points = points.unionByName(lines.join(chosen, [*split, "_run"], "left_semi").select(*split, "_seq", "_month"))
    inside = Window.partitionBy(*split).orderBy("_seq")
    steps = points.withColumn("_step", F.coalesce(_new_years(F.lag("_month").over(inside), F.col("_month")), F.lit(0)))
    step = F.struct(F.col("_seq").alias("at"), F.col("_step").alias("years"))
    # One row per split: its steps (seldom any), the months at its ends and its last time.
    months = steps.groupBy(*split).agg(
        F.sum("_step").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("_step") != 0, step))).alias("_steps"),
        F.min_by("_month", "_seq").alias("_first"), F.max_by("_month", "_seq").alias("_last"))
    ends = runs.groupBy(*split).agg(F.max("_modified").alias("_modified"), F.max_by("_time", "_run").alias("_time"))
    log = Window.partitionBy("file_entry").orderBy(*file_order(split[1:]))
    table = months.join(ends, split).withColumn("_enter", F.coalesce(_new_years(F.lag("_last").over(log), F.col("_first")), F.lit(0)))
    whole = log.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.select(
        *split, "_steps", F.sum(F.col("_enter") + F.col("_n")).over(log).alias("_sum"), "_n",
        F.sum(F.col("_enter") + F.col("_n")).over(whole).alias("_all"),
        F.last(_last_year(F.col("_time"), F.col("_modified").cast("timestamp_ntz"), tolerance_hours)).over(whole).alias("_year"))
    table.select(*split, "_steps", (F.col("_year") - F.col("_all") + F.col("_sum") - F.col("_n")).alias("_year")).write.mode("overwrite").parquet(path + "/splits")
    table = spark.read.parquet(path + "/splits")
    size = table.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.sum(F.size("_steps")), F.lit(0)).alias("steps")).first()
    small = size["splits"] + size["steps"] <= MAX_BROADCAST_ROWS
    seq = F.col("_seq")
    passed = F.aggregate("_steps", F.lit(0).cast("long"), lambda n, s: n + F.when(s["at"] <= seq, s["years"]).otherwise(0).cast("long"))
    rows = staged.join(F.broadcast(table) if small else table, split, "left")
    time = in_year(F.col("timestamp"), F.col("_year") + passed)
    return rows.withColumn("timestamp", time).select(*[c for c in staged.columns if c != "file_modification_time"])
