"""Dense file-order sequence numbers without a global sort of the rows.

Rows carry (list entry, file, split, ``monotonically_increasing_id`` taken in the scan).
One aggregate counts rows per split and records each split's smallest id; a
running sum over the splits (one row per split) gives each split's offset,
which is materialised and joined back. Up to SINGLE_TASK_SPLITS splits the
running sum is one window; beyond that the split table is range-partitioned
into ordered slices of at most that size, each slice sums locally and a prefix
over the slice totals (one row per slice) is added, so no task ever holds more
than SINGLE_TASK_SPLITS rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.syslog import ORDER_COLUMNS, file_order

# A split table larger than this is joined by shuffle instead of broadcast
# (at 128 MiB splits this is ~250 TiB of text).
MAX_BROADCAST_SPLITS = 2_000_000
# Most split rows one task sums (~25 TiB of text at 128 MiB splits).
SINGLE_TASK_SPLITS = 200_000


def _materialise(df: DataFrame, path: str | None) -> DataFrame:
    """Write ``df`` once (to ``path`` or the checkpoint folder) and read it back."""
    if path:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    return df.checkpoint(eager=True)


def split_offsets(splits: DataFrame, order_cols: list[str], n: int, path: str | None = None) -> DataFrame:
    """``_off`` = number of rows in all earlier splits, for a materialised
    split table of ``n`` rows with ``_n`` rows per split. Deterministic: the
    input is fixed and the order columns are unique."""
    before, order = Window.unboundedPreceding, file_order(order_cols)
    if n <= SINGLE_TASK_SPLITS:
        w = Window.orderBy(*order).rowsBetween(before, -1)
        return splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    slices = -(-n // SINGLE_TASK_SPLITS)
    # Range partitions are contiguous and ordered; materialising fixes which
    # split falls into which slice.
    ranged = _materialise(splits.repartitionByRange(slices, *order)
                                .withColumn("_slice", F.spark_partition_id()),
                          path and path + "/slices")
    totals = ranged.groupBy("_slice").agg(F.sum("_n").alias("_sn"))            # one row per slice
    slice_off = totals.select("_slice", F.coalesce(F.sum("_sn").over(
        Window.orderBy("_slice").rowsBetween(before, -1)), F.lit(0)).alias("_soff"))
    local = ranged.withColumn("_loff", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_slice").orderBy(*order).rowsBetween(before, -1)), F.lit(0)))
    return (local.join(F.broadcast(slice_off), "_slice")
                 .withColumn("_off", F.col("_soff") + F.col("_loff"))
                 .drop("_slice", "_soff", "_loff"))


def number_rows(rows: DataFrame, id_col: str = "id", base=0,
                order_cols=ORDER_COLUMNS, seq_col: str | None = None, with_total: bool = False,
                offsets_path: str | None = None):
    """Attach ``id_col`` = base + 1, 2, 3 ... in (file, split, line) order.

    ``rows`` may already be filtered: numbering counts only the rows present.
    ``base`` continues an existing table. ``seq_col`` names a stored sequence
    taken at the scan (``monotonically_increasing_id`` right after the same
    filter, see ``stage_lines``); without it the sequence is taken here and the
    input is read twice, which is only exact when both jobs split the files the
    same way (split size follows the core count for small inputs, so executors
    joining or leaving in between could change it): the library's imports and feeds
    therefore always use a stored sequence. ``with_total`` also returns the
    number of rows (from the split table, no extra pass). ``offsets_path``
    writes the split table there (for callers that remove their own scratch
    data) instead of to the checkpoint folder.
    """
    order_cols = list(order_cols)
    if seq_col:
        seq = rows if seq_col == "_seq" else rows.withColumnRenamed(seq_col, "_seq")
    else:
        seq = rows.withColumn("_seq", F.monotonically_increasing_id())
    splits = _materialise(seq.groupBy(*order_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_seq0")),
                          offsets_path and offsets_path + "/splits")
    stats = splits.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    offsets = split_offsets(splits, order_cols, int(stats["splits"]), offsets_path).select(*order_cols, "_seq0", "_n", "_off")
    right = F.broadcast(offsets) if stats["splits"] <= MAX_BROADCAST_SPLITS else offsets
    out = seq.join(right.drop("_n"), order_cols, "inner")
    out = (out.withColumn(id_col, F.lit(base).cast("bigint") + F.col("_off") + F.col("_seq") - F.col("_seq0") + 1)
              .drop("_seq", "_seq0", "_off"))
    return (out, int(stats["rows"])) if with_total else out
