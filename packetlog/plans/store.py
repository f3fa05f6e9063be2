"""Packet and host tables: create, list, drop, clear, import (append or
clear-then-import), all through the catalog or plain Parquet paths.

An append is one job commit (all or nothing) instead of the original's
100-row INSERT batches; ids continue after the table's current maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULT_DNS_TABLE, DEFAULT_LOGS_TABLE, DNS_SCHEMA, LOGS_COLUMNS, LOGS_SCHEMA
from ..sources.syslog import read_syslog
import uuid

from ..functions.eventtime import utc_now
from ..operators.hosts import PRUNE_MAX_AGE_HOURS, prune_hosts, upsert_hosts
from ..session import delete_path, scratch_path
from ..operators.parse import rejects
from ..operators import reports
from ..operators.reports import merge_rollups, report_rollup
from .ingest import number_staged, stage_lines
from .versions import KEPT_VERSIONS, Measure, VersionedTable


def _quote(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def create_table(spark: SparkSession, name: str = DEFAULT_LOGS_TABLE, path: str | None = None,
                 schema=LOGS_SCHEMA) -> DataFrame:
    """Create an empty packet table; fails if it exists (as the original)."""
    if spark.catalog.tableExists(name):
        raise ValueError(f"table {name} already exists")
    kwargs = {"path": path} if path else {}
    return spark.catalog.createTable(name, source="parquet", schema=schema, **kwargs)


def create_host_table(spark: SparkSession, name: str = DEFAULT_DNS_TABLE, path: str | None = None) -> DataFrame:
    return create_table(spark, name, path, DNS_SCHEMA)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Numbered table names of the current (or given) database."""
    from pyspark.sql import Window
    shown = spark.sql("SHOW TABLES" + (f" IN {_quote(database)}" if database else ""))
    # One row per catalog table: metadata, not data.
    return shown.where(~F.col("isTemporary")).select(
        F.row_number().over(Window.orderBy("tableName")).alias("number"), F.col("tableName").alias("name"))


def drop_table(spark: SparkSession, name: str = DEFAULT_LOGS_TABLE) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quote(name)}")


def clear_table(spark: SparkSession, name: str = DEFAULT_LOGS_TABLE) -> None:
    """Remove every row, keep the table (also one made with a path)."""
    spark.createDataFrame([], spark.table(name).schema).write.insertInto(name, overwrite=True)
    spark.catalog.refreshTable(name)


def _next_base(existing: DataFrame | None) -> int:
    if existing is None:
        return 0
    top = existing.agg(F.max("id").alias("m")).first()["m"]
    return int(top or 0)


def import_log(spark: SparkSession, paths, name: str = DEFAULT_LOGS_TABLE, clear: bool = False,
               year=None, rejects_path: str | None = None) -> DataFrame:
    """Import log files into the catalog table ``name``.

    ``clear`` replaces the table's rows: the new files are committed first and
    the old ones deleted after that, so a write that fails leaves the old rows.
    (A driver lost between the two steps leaves both; importing again mends
    it. ``import_packets`` does it in one commit, and lets imports run at the same
    time.) Returns the one-row import summary.
    """
    lines = read_syslog(spark, paths)
    base = 0 if clear else _next_base(spark.table(name))
    with _staged(spark, lines, year, base) as staged:
        old = spark.table(name).inputFiles() if clear else []
        staged.rows.write.insertInto(name)
        _delete_files(spark, old)
        spark.catalog.refreshTable(name)
        if rejects_path:
            staged.write_rejects(rejects_path)
        return staged.summary()


def _delete_files(spark: SparkSession, files: list[str]) -> None:
    """Delete input files by the names that Spark reports: encoded URIs."""
    jvm = spark.sparkContext._jvm
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False):
            raise OSError(f"could not delete {file}: the table holds old and new rows")


class _staged:
    """Packet rows of ``lines`` through a staging table in the shared scratch
    folder: the text is scanned and parsed once; ids come from the staged
    position columns. The staging folder is removed after the final write."""

    def __init__(self, spark, lines, year, base):
        self.spark, self.lines, self.year, self.base = spark, lines, year, base
        self.path = scratch_path(spark, "staging", uuid.uuid4().hex)

    def __enter__(self) -> "_staged":
        # Lines read are counted during the staging scan itself (no extra pass).
        self.observation = Observation("import")
        observed = self.lines.observe(self.observation, F.count(F.lit(1)).alias("lines_read"))
        try:
            self.staged = stage_lines(observed, self.path + "/rows", self.year)
            self.numbered = number_staged(self.staged, self.base, offsets_path=self.path + "/offsets")
        except Exception:
            delete_path(self.spark, self.path)
            raise
        self.rows = self.numbered.where("ok").select(*LOGS_COLUMNS)
        return self

    def write_rejects(self, path: str) -> None:
        """Lines that carried the marker substring but could not be parsed,
        with their id and reason (appended to ``path``)."""
        rejects(self.numbered.where(~F.col("ok"))).write.mode("append").parquet(path)

    def summary(self) -> DataFrame:
        """Import summary from the observed line count and the staged table."""
        c = self.staged.agg(F.count(F.lit(1)).alias("m"), F.count_if("ok").alias("p")).first()
        values = [(int(self.observation.get["lines_read"]), int(c["m"]), int(c["p"]), int(c["m"] - c["p"]))]
        return self.spark.createDataFrame(values, "lines_read long, marker_lines long, parsed long, rejected long")

    def __exit__(self, *exc):
        delete_path(self.spark, self.path)
        return False


def import_log_to_path(spark: SparkSession, lines: DataFrame, path: str, clear: bool = False,
                       year=None, rejects_path: str | None = None) -> DataFrame:
    """Path-table variant of ``import_log`` (Parquet files at ``path``);
    ``lines`` come from ``read_syslog``. Returns the import summary."""
    from ..session import path_exists
    existing = None
    if not clear and path_exists(spark, path):
        existing = spark.read.parquet(path)
    base = _next_base(existing)
    # As in import_log: commit the new files, then delete the old ones.
    old = spark.read.schema(LOGS_SCHEMA).parquet(path).inputFiles() if clear and path_exists(spark, path) else []
    with _staged(spark, lines, year, base) as staged:
        staged.rows.write.mode("append").parquet(path)
        _delete_files(spark, old)
        if rejects_path:
            staged.write_rejects(rejects_path)
        return staged.summary()


def empty_table_at(spark: SparkSession, path: str, schema=LOGS_SCHEMA) -> None:
    """Empty overwrite of a path table (clear for tables kept as paths)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


# Packet table and host table as versions behind a commit log: an import, a clear, an
# upsert or a prune is one commit, whatever other writers do (see ``versions``).

KEPT_SNAPSHOTS = KEPT_VERSIONS


#: Roll-ups of imports that are kept side by side before they are merged.
MERGE_ROLLUPS = 8


def packet_table(spark: SparkSession, root: str, rollup: bool | str = False) -> VersionedTable:
    measure = Measure(reports.rollup_facts(), lambda a, b: reports.merge_facts(spark, a, b),
                      lambda facts: reports.rollup_pays(spark, facts)) if rollup == "auto" else None
    return VersionedTable(spark, root, LOGS_SCHEMA, derive=report_rollup if rollup else None, measure=measure)


def stored_analysis(spark: SparkSession, root: str, limit: int = reports.DEFAULT_LIMIT, numeric_ips: bool = False,
                    with_rank: bool = False) -> dict[str, DataFrame]:
    """The six reports of the newest version: from the stored roll-ups where all
    packets have one, else by a roll-up made now or by six scans, as the sketch in the
    log says (or one taken now, if some imports left none)."""
    table = packet_table(spark, root, rollup=True)
    state = table.state()
    if state["folders"] and set(state.get("covers", [])) == set(state["folders"]):
        return reports.analysis_from_rollup(table.read_derived(state["version"]), limit, numeric_ips, with_rank)
    facts = table.facts(state)
    plan = "auto" if facts is None else reports.rollup_pays(spark, facts)
    return reports.analysis(table.read(state["version"]), limit, plan, numeric_ips, with_rank)


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The stored roll-up of the newest version, for ``reports.analysis_from_rollup``.
    Imports made without one are rolled up from their packets."""
    return packet_table(spark, root, rollup=True).read_derived()


def read_packets(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of the packet table at ``root``."""
    return packet_table(spark, root).read()


def import_packets(spark: SparkSession, lines: DataFrame, root: str, clear: bool = False, year=None,
                   rejects_path: str | None = None, rollup: bool | str = False) -> DataFrame:
    """Import ``lines`` (from ``read_syslog``) into the versioned packet table at
    ``root``. Ids follow those given out before, from a range that is reserved
    first, so imports may run at the same time. ``clear`` puts the new rows in place
    of all others in one commit: readers see the old rows or the new ones, and a
    failed import changes nothing. With ``rollup`` the new packets' roll-up is stored in
    the same commit, and every ``MERGE_ROLLUPS`` of them are merged: reports then read
    no packets. ``rollup="auto"`` takes a distinct-count sketch of the roll-up's keys while
    the packets are written, keeps it in the log, and stores the roll-up only if that
    pays. Returns the import summary."""
    table = packet_table(spark, root, rollup)
    with _staged(spark, lines, year, 0) as staged:
        n = staged.staged.count()
        (table.renew if clear else table.append)(staged.rows, n)
        if rollup:
            table.merge_derived(merge_rollups, MERGE_ROLLUPS)
        if rejects_path:
            staged.write_rejects(rejects_path)
        return staged.summary()


def clear_packets(spark: SparkSession, root: str) -> None:
    packet_table(spark, root).clear()


def host_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, root, DNS_SCHEMA)


def read_host_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version (an empty table when there is none)."""
    return host_table(spark, root).read()


def write_host_table(spark: SparkSession, root: str, table: DataFrame) -> str:
    """Write ``table`` as the next version and return its path, whatever the
    current one holds. A failed write changes nothing."""
    return host_table(spark, root).replace(lambda _: table)


def upsert_host_table(spark: SparkSession, root: str, new: DataFrame) -> str:
    """Add or replace entries by address; concurrent upserts all take effect.
    ``new`` may be computed again if another writer commits meanwhile."""
    return host_table(spark, root).replace(lambda current: upsert_hosts(current, new))


def prune_host_table(spark: SparkSession, root: str, hours: int = PRUNE_MAX_AGE_HOURS, now=None) -> str:
    """Drop entries older than ``hours``."""
    now = now if now is not None else utc_now()
    return host_table(spark, root).replace(lambda current: prune_hosts(current, hours, now))


def clear_host_table(spark: SparkSession, root: str) -> None:
    """No entries (the host-cache clear)."""
    host_table(spark, root).clear()


def register_views(spark: SparkSession, logs: DataFrame, hosts: DataFrame | None = None,
                   logs_view: str = DEFAULT_LOGS_TABLE, hosts_view: str = DEFAULT_DNS_TABLE) -> None:
    """Custom queries (promised by the original tool's manual, never built):
    register the packet table (and the host table) as temporary views, then
    use ``spark.sql``. Catalyst plans them like the built-in reports."""
    logs.createOrReplaceTempView(logs_view)
    if hosts is not None:
        hosts.createOrReplaceTempView(hosts_view)
