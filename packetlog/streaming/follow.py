"""Live packet feed as a Structured Streaming query.

The feed follows a directory that rotated log files land in (``follow``), or log
files that grow, through their rotations (``follow_file``). Each micro-batch is parsed
by the same batch code, numbered in file order and continued from the running packet
count, which every batch stores with its id and takes from its predecessor. Both
writes of a batch are overwrites keyed by the batch id, so a retried batch gives the
same result. Host names come from the newest host table at the time of the batch, of
which only the batch's own addresses are taken.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.feed import feed_filter
from ..operators.hosts import FEED_HOST_WIDTH, name_feed
from ..plans.ingest import parse_log
from ..plans.versions import create_once, read_text
from ..operators.parse import packets as accepted
from ..sources.syslog import without_cr
from ..session import delete_path, path_exists, scratch_path
from .tail import FORMAT, SPLIT_BYTES, GrowingLog, start_offsets

POLL_SECONDS = 1

_TEXT_SCHEMA = T.StructType([T.StructField("value", T.StringType(), True)])


def stream_lines(spark: SparkSession, directory: str, from_start: bool = False,
                 start_time: _dt.datetime | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines of files arriving in ``directory`` (in arrival order, oldest
    first). Unless ``from_start``, only files modified after ``start_time``
    (default: now) are read, the stream equivalent of starting at the end of
    the log."""
    reader = spark.readStream.format("text").schema(_TEXT_SCHEMA).option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = (reader.load(directory)
          .select(without_cr("value").alias("value"),
                  F.lit(0).alias("file_entry"),
                  F.col("_metadata.file_path").alias("file_path"),
                  F.col("_metadata.file_block_start").alias("file_block_start"),
                  F.col("_metadata.file_modification_time").alias("file_modification_time")))
    if not from_start:
        start = start_time or _dt.datetime.now()
        df = df.where(F.col("file_modification_time") > F.lit(start))
    return df


def _packets_before(spark: SparkSession, counts_path: str, batch_id: int) -> int:
    """The running count of the batch before: one small file."""
    before = f"{counts_path}/batch_id={batch_id - 1}"
    if batch_id == 0:
        return 0
    if path_exists(spark, before):
        row = spark.read.parquet(before).first()
        if "total" in row.asDict():
            return row["total"]
    # A sink without running counts, or with a gap: sum what is there.
    if not path_exists(spark, counts_path):
        return 0
    earlier = spark.read.option("mergeSchema", "true").parquet(counts_path).where(F.col("batch_id") < batch_id)
    return earlier.agg(F.coalesce(F.sum("packets"), F.lit(0))).first()[0]


def _feed_batch(sink: str, no_lo: bool, no_accept: bool, year, cache, now):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts_path = f"{sink}/_counts"
        base = _packets_before(spark, counts_path, batch_id)
        parsed, n_marker = parse_log(batch, year=year, base=int(base), with_total=True,
                                     staging=f"{sink}/_staging/batch_id={batch_id}")
        rows = accepted(parsed)
        rows = feed_filter(rows, no_lo, no_accept)
        if cache is not None:
            table = cache(spark) if callable(cache) else cache
            wanted = rows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
            rows = name_feed(rows, table.join(wanted, "ip", "left_semi"), now=now, width=FEED_HOST_WIDTH)
        rows = rows.withColumn("arrival", F.current_timestamp())
        rows.write.mode("overwrite").parquet(f"{sink}/feed/batch_id={batch_id}")
        (spark.createDataFrame([(int(n_marker), int(base + n_marker))], "packets long, total long")
              .write.mode("overwrite").parquet(f"{counts_path}/batch_id={batch_id}"))
        # Both outputs are committed: the batch's staging data is no longer needed
        # (a retried batch stages again).
        delete_path(spark, f"{sink}/_staging/batch_id={batch_id}")
    return run


def follow(spark: SparkSession, directory: str, sink: str | None = None, checkpoint: str | None = None,
           from_start: bool = False, no_lo: bool = False, no_accept: bool = False, year=None,
           cache: DataFrame | Callable[[SparkSession], DataFrame] | None = None, now=None, available_now: bool = False,
           start_time: _dt.datetime | None = None, max_files_per_trigger: int | None = None):
    """Start the feed; returns ``(query, sink)``. Rows land in ``sink/feed``
    (partitioned by batch id) with ``packet_no`` = ``id`` and an ``arrival``
    time. ``cache`` is a host table, or a function of the session that reads one: it
    is asked for every batch, so names stored meanwhile show in the next batch.
    ``available_now`` processes what is there and stops (scan mode)."""
    sink, checkpoint = _places(spark, sink, checkpoint)
    lines = stream_lines(spark, directory, from_start, start_time, max_files_per_trigger)
    return _start(lines, sink, checkpoint, available_now, no_lo, no_accept, year, cache, now)


def grown_lines(spark: SparkSession, paths: str | list[str], checkpoint: str, from_start: bool = False,
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines appended to the given files (columns of ``read_syslog``). The place where
    the feed begins is kept with the checkpoint, so every later start with it goes on
    from there, also if no batch was finished before."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kept = f"{checkpoint}/_tail_start.json"
    if not path_exists(spark, kept):
        create_once(spark, kept, json.dumps(start_offsets(paths, from_start)))
    spark.dataSource.register(GrowingLog)
    lines = (spark.readStream.format(FORMAT).option("paths", json.dumps(paths))
             .option("start", read_text(spark, kept)).option("splitBytes", str(split_bytes)).load())
    return lines.withColumn("value", without_cr("value"))


def follow_file(spark: SparkSession, paths: str | list[str], sink: str | None = None, checkpoint: str | None = None,
                from_start: bool = False, no_lo: bool = False, no_accept: bool = False, year=None,
                cache: DataFrame | Callable[[SparkSession], DataFrame] | None = None, now=None,
                available_now: bool = False, split_bytes: int = SPLIT_BYTES):
    """The feed of log files that grow, from their end or ``from_start``; the other
    parameters and the result are those of ``follow``."""
    sink, checkpoint = _places(spark, sink, checkpoint)
    lines = grown_lines(spark, paths, checkpoint, from_start, split_bytes)
    return _start(lines, sink, checkpoint, available_now, no_lo, no_accept, year, cache, now)


def _places(spark: SparkSession, sink: str | None, checkpoint: str | None) -> tuple[str, str]:
    sink = sink or scratch_path(spark, "feeds", uuid.uuid4().hex[:12])
    return sink, checkpoint or f"{sink}/_checkpoint"


def _start(lines: DataFrame, sink: str, checkpoint: str, available_now: bool, *batch_options):
    writer = (lines.writeStream.foreachBatch(_feed_batch(sink, *batch_options))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")
    return writer.start(), sink


def read_feed(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/feed")
