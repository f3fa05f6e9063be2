"""Packet and host tables derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import LOGS_SCHEMA
from ..session import path_exists, scratch_path
from ..sources.fixtures import (BUILD_LOCK, FIXTURE_YEAR, _key, fixture_log_path,
                                host_cache_from_customers)
from ..sources.syslog import read_syslog
from .store import import_log_to_path


def fixture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered syslog files of ``sf_dir``, read as a log."""
    return read_syslog(spark, fixture_log_path(spark, sf_dir))


def fixture_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet table imported from the rendered log (imported once per
    scale, then read as Parquet, as the analysis reads a stored table)."""
    path = scratch_path(spark, "fixtures", _key(sf_dir), "logs")
    with BUILD_LOCK:
        if not path_exists(spark, path + "/_SUCCESS"):
            import_log_to_path(spark, fixture_lines(spark, sf_dir), path, clear=True, year=FIXTURE_YEAR)
    return spark.read.schema(LOGS_SCHEMA).parquet(path)


def fixture_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host table derived from ``customer``."""
    return host_cache_from_customers(spark.read.parquet(f"{sf_dir}/customer.parquet"))
