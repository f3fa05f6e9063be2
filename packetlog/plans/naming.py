"""Read-through host naming: look up, resolve what is missing, store, then name.

The original asked the cache for each address, resolved a miss on the spot and
stored the answer, positive or negative. Here the distinct addresses are taken at
once: those without a fresh entry are resolved in parallel tasks, the answers are
committed to the versioned host table as one upsert (concurrent runs all keep their
answers), and the rows are named from the version that results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eventtime import utc_now
from ..operators.hosts import READ_MAX_AGE_HOURS, name_feed, name_report, resolve_hosts, unknown_addresses
from .store import read_host_table, upsert_host_table

Resolver = Callable[[list[str]], list[str | None]]


def resolve_through(spark: SparkSession, root: str, addresses: DataFrame, resolver: Resolver, now=None,
                    max_age_hours: int = READ_MAX_AGE_HOURS, **options) -> int:
    """Make sure that the host table at ``root`` has a fresh entry for every ``ip`` of
    ``addresses``; returns the number of entries added. Addresses with a fresh
    entry, also a negative one, are not resolved again. ``options``: see
    ``resolve_hosts``."""
    now = now if now is not None else utc_now()
    missing = unknown_addresses(addresses, read_host_table(spark, root), now, max_age_hours)
    found = resolve_hosts(missing, resolver, now, **options)
    n = found.count()
    if n:
        upsert_host_table(spark, root, found)
    return n


def _addresses(rows: DataFrame, ip_cols) -> DataFrame:
    return rows.select(F.explode(F.array(*[F.col(c) for c in ip_cols])).alias("ip"))


def name_reports_through(reports: dict[str, DataFrame], spark: SparkSession, root: str, resolver: Resolver, now=None,
                         **options) -> dict[str, DataFrame]:
    """Reports (numeric addresses) with display names; the addresses of all of them
    (at most two a row) are resolved together."""
    now = now if now is not None else utc_now()
    columns = {n: tuple(c for c in ("src_ip", "dst_ip") if c in r.columns) for n, r in reports.items()}
    kept = {n: r.checkpoint(eager=True) if columns[n] else r for n, r in reports.items()}
    parts = [_addresses(kept[n], c) for n, c in columns.items() if c]
    if parts:
        resolve_through(spark, root, reduce(DataFrame.unionByName, parts), resolver, now, **options)
    hosts = read_host_table(spark, root)
    return {n: name_report(r, hosts, ip_cols=columns[n], now=now) if columns[n] else r for n, r in kept.items()}


def name_feed_through(feed: DataFrame, spark: SparkSession, root: str, resolver: Resolver, now=None,
                      row_key: str | None = "id", **options) -> DataFrame:
    """A packet feed with display names, all its addresses resolved first."""
    now = now if now is not None else utc_now()
    resolve_through(spark, root, _addresses(feed, ("src_ip", "dst_ip")), resolver, now, **options)
    return name_feed(feed, read_host_table(spark, root), now=now, row_key=row_key)
