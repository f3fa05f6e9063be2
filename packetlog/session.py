"""Session helpers: a local session for tests/bench and the shared scratch folder.

Library code never assumes a particular session configuration; it only reads
``spark.checkpoint.dir`` (the shared folder a cluster names for lineage cuts and
derived tables); a local session without one gets a private folder.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "packetlog", extra: dict | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    parts = shuffle_partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Fall back from whole-stage codegen where a generated method would be
        # too large for the JIT compiler (the HotSpot limit, as Spark's docs
        # advise): the parser's fused code otherwise runs interpreted, 4x slower.
        .config("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_LIMIT))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_root(spark)
    return spark


JIT_METHOD_LIMIT = 8000


@contextlib.contextmanager
def jit_sized_codegen(spark: SparkSession):
    """Within the block, whole-stage codegen gives way to per-expression code
    where a fused method would exceed the JIT size limit (unless the session
    already sets a lower limit); the previous setting is restored after."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    if before is not None and int(before) <= JIT_METHOD_LIMIT:
        yield
        return
    spark.conf.set(key, str(JIT_METHOD_LIMIT))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and derived tables.

    Order: the context's checkpoint folder, then ``spark.checkpoint.dir`` from
    the configuration; only when both are unset and the master is local (tests)
    a private folder is created and registered as the checkpoint folder. On a
    cluster an unset folder is an error: executors share no local disk.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="packetlog-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([scratch_root(spark), "packetlog", *parts])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the session (works on
    any shared store the cluster uses, not only the local disk)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote (staging data) from the shared store."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def rename_path(spark: SparkSession, path: str, new: str) -> None:
    """Give a file or folder another name."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(hpath, jvm.org.apache.hadoop.fs.Path(new))
