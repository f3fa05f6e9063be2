"""Shared helpers of the corpus operators.

Conventions all operators keep:

* A document is a row of ``(doc_id, text)``. Rows equal in both are one
  document: they get the same result and are kept or dropped alike.
* A null text counts as the empty text unless an operator says otherwise.
* Operators read only the columns they name and return only the columns they
  document, so further columns of the input never clash with theirs. Pipeline
  stages return exactly the columns they were given.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.session import delete_path, scratch_path, scratch_root

DOC_ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(column: str = TEXT) -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def text_hash(column: str = TEXT) -> Column:
    """With ``doc_id``, what identifies a document (see the module docstring)."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def id_remainder(modulus: int, column: str = DOC_ID) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (fixed hold-out folds);
    a null id has the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table of several readers to the shared folder and read it back;
    the folder goes to ``drop`` when nobody reads it any more."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        delete_path(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now. It does so once their
    plans are garbage, and a driver with a large heap may not collect that for hours,
    while the executors' disks fill; only operators with large shuffles ask for it."""
    for _ in range(2):  # plans go first, then what only they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
