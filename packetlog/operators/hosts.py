"""IP-to-host table: fresh lookups, enrichment of reports and feeds, the list
of addresses still to resolve, upsert, prune, dump.

The original looked hosts up one printed row at a time (a new connection per
lookup). Here naming is an outer equi-join, done after the top-N cut for
reports (so both sides of that join are bounded by the limit) and with a
size-checked broadcast or, for whole feeds, a shuffle of the rarer addresses alone.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.eventtime import is_fresh, ntz_literal, survives_prune, utc_now
from ..functions.fields import trim_host
from ..functions.ipaddr import long_to_ip

READ_MAX_AGE_HOURS = 300    # age accepted when reading a cached name
PRUNE_MAX_AGE_HOURS = 336   # default age limit of a prune
# Fixed value: row format of the printed dump.
HOST_DUMP_FORMAT = "%20s    %-50s"
REPORT_HOST_WIDTH = 25
FEED_HOST_WIDTH = 30

# Fresh host tables up to this many rows and about this many bytes (8 per
# address + host text + 24 per row of overhead) are broadcast to the feed.
MAX_BROADCAST_HOSTS = 1_000_000
MAX_BROADCAST_BYTES = 128 * 1024 * 1024
# Addresses whose packets are joined through a broadcast of their names instead
# of the shuffle: every other address holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
# Lookups of one task, unless more tasks than allowed would be needed.
LOOKUPS = 32


def fresh_hosts(cache: DataFrame, now=None, max_age_hours: int = READ_MAX_AGE_HOURS) -> DataFrame:
    """``ip, host`` of entries written less than ``max_age_hours`` before ``now``."""
    now = now if now is not None else utc_now()
    return cache.where(is_fresh("ttl", now, max_age_hours)).select("ip", "host")


def lookup_hosts(cache: DataFrame, addresses: DataFrame, ip_col: str = "ip", now=None,
                 max_age_hours: int = READ_MAX_AGE_HOURS) -> DataFrame:
    """Cache get for many addresses at once: every row of ``addresses`` with
    ``host`` = the fresh cached name or NULL (not cached, or too old). The host
    table is first reduced to the distinct addresses that occur, so a broadcast
    or a skew-split join back suffices for hot addresses."""
    fresh = fresh_hosts(cache, now, max_age_hours).withColumnRenamed("ip", "_ip")
    wanted = addresses.select(F.col(ip_col).alias("_ip")).where("_ip IS NOT NULL").distinct()
    named = fresh.join(wanted, "_ip", "left_semi")
    return addresses.join(named, addresses[ip_col] == named["_ip"], "left").drop("_ip")


def display_name(host: Column, ip: Column, width: int) -> Column:
    """Cached host (trimmed to ``width``), else the dotted address."""
    return F.coalesce(trim_host(host, width), long_to_ip(ip))


def name_report(report: DataFrame, cache: DataFrame, ip_cols=("src_ip", "dst_ip"), now=None,
                width: int = REPORT_HOST_WIDTH, max_age_hours: int = READ_MAX_AGE_HOURS,
                suffix: str = "_name") -> DataFrame:
    """Add ``<col>_name`` for each numeric address column of a top-N report.

    The report holds at most 1000 rows, so its distinct addresses (at most two
    per row) are broadcast to filter the host table, and the matching names
    (as many) are broadcast back: the host table is only scanned through that
    filter, never shuffled, and the report is never shuffled.
    """
    # The report is bounded by the limit; checkpoint it so the top-N runs once
    # although it feeds both the address list and the joins.
    report = report.checkpoint(eager=True)
    fresh = fresh_hosts(cache, now, max_age_hours)
    ips = report.select(F.explode(F.array(*[F.col(c) for c in ip_cols])).alias("ip")).where("ip IS NOT NULL").distinct()
    names = F.broadcast(fresh.join(F.broadcast(ips), "ip", "inner"))
    out = report
    for c in ip_cols:
        n = names.alias(f"_n_{c}")
        out = (out.join(n, out[c] == F.col(f"_n_{c}.ip"), "left")
                  .withColumn(c + suffix, display_name(F.col(f"_n_{c}.host"), out[c], width))
                  .select(*out.columns, c + suffix))
    return out


def name_feed(feed: DataFrame, cache: DataFrame, ip_cols=("src_ip", "dst_ip"), now=None,
              width: int = FEED_HOST_WIDTH, max_age_hours: int = READ_MAX_AGE_HOURS,
              suffix: str = "_name", row_key: str | None = "id",
              max_broadcast: int = MAX_BROADCAST_HOSTS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Add ``<col>_name`` to every row of an unbounded packet DataFrame.

    * Fresh host table of at most ``max_broadcast`` rows and MAX_BROADCAST_BYTES
      (both measured first, in one aggregate): broadcast hash join, the feed
      is not shuffled.
    * Larger: the table is first reduced to the addresses that occur in the feed
      (``distinct`` combines map-side) and measured again; if that fits, as above.
    * Larger still: the HOT_KEYS most frequent addresses of a column (found by a
      map-side combined count) get their names through a broadcast of at most
      HOT_KEYS rows; their rows, and rows with a NULL address, stay where they are.
      Only the other rows are shuffled: each of their addresses holds at most
      1/HOT_KEYS of the rows (``hot_keys`` overrides HOT_KEYS).

    ``row_key`` has no effect any more: no row needs a key to be spread by.
    """
    fresh = fresh_hosts(cache, now, max_age_hours)
    small = _broadcastable(fresh, max_broadcast)
    if not small:
        present = feed.select(F.explode(F.array(*[F.col(c) for c in ip_cols])).alias("ip")).where("ip IS NOT NULL").distinct()
        fresh = fresh.join(present, "ip", "left_semi").checkpoint(eager=True)
        small = _broadcastable(fresh, max_broadcast)
    # Hot addresses per column, counted on the feed itself (not on a partly
    # joined result, which would repeat the earlier joins).
    hots = {} if small else {
        c: (feed.where(F.col(c).isNotNull()).groupBy(c).count()
                .orderBy(F.col("count").desc(), F.col(c)).limit(hot_keys)
                .select(F.col(c).alias("ip"))
                .checkpoint(eager=True))       # at most HOT_KEYS rows, used three times
        for c in ip_cols}
    out = feed
    for c in ip_cols:
        ipc, hostc = f"_ip_{c}", f"_host_{c}"
        n = fresh.select(F.col("ip").alias(ipc), F.col("host").alias(hostc))
        if small:
            out = out.join(F.broadcast(n), out[c] == n[ipc], "left")
        else:
            hot = hots[c]
            hot_hosts = fresh.join(F.broadcast(hot), "ip", "inner")        # at most HOT_KEYS rows
            hot_names = (hot.join(F.broadcast(hot_hosts), "ip", "left")
                            .select(F.col("ip").alias(ipc), F.col("host").alias(hostc), F.lit(True).alias("_is_hot")))
            marked = out.join(F.broadcast(hot_names), out[c] == hot_names[ipc], "left")
            here = marked.where(F.col("_is_hot") | F.col(c).isNull()).drop("_is_hot")
            rest = marked.where(F.col("_is_hot").isNull() & F.col(c).isNotNull()).select(*out.columns)
            cold = n.join(F.broadcast(hot.withColumnRenamed("ip", ipc)), ipc, "left_anti")
            out = here.unionByName(rest.join(cold, rest[c] == cold[ipc], "left"))
        out = out.withColumn(c + suffix, display_name(F.col(hostc), F.col(c), width)).drop(ipc, hostc)
    return out


def _broadcastable(hosts: DataFrame, max_rows: int) -> bool:
    size = hosts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("host")), F.lit(0)).alias("chars")).first()
    return size["rows"] <= max_rows and size["rows"] * 32 + size["chars"] <= MAX_BROADCAST_BYTES


def hosts_to_resolve(logs: DataFrame, cache: DataFrame, now=None,
                     max_age_hours: int = READ_MAX_AGE_HOURS) -> DataFrame:
    """Distinct source and destination addresses with no fresh host entry.

    ``distinct`` combines map-side, so a hot address costs nothing; both sides
    of the anti join are unique per address."""
    return unknown_addresses(logs.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")), cache, now, max_age_hours)


def unknown_addresses(addresses: DataFrame, cache: DataFrame, now=None,
                      max_age_hours: int = READ_MAX_AGE_HOURS) -> DataFrame:
    """The distinct non-null ``ip`` of ``addresses`` with no fresh host entry."""
    ips = addresses.select("ip").where(F.col("ip").isNotNull()).distinct()
    return ips.join(fresh_hosts(cache, now, max_age_hours).select("ip"), "ip", "left_anti")


def resolve_hosts(missing: DataFrame, resolver: Callable[[list[str]], list[str | None]], now=None,
                  parallel: int = 64, retries: int = 2) -> DataFrame:
    """Name addresses with a caller-supplied resolver, in Arrow batches on the
    executors. ``resolver`` maps a list of dotted addresses to host names
    (None = failed). Lookups wait on the network, so they are spread over tasks of
    ``LOOKUPS`` addresses, up to ``parallel`` tasks at once. A failed lookup becomes a
    negative entry: host = the dotted address, as the original stored it. A resolver
    that raises is asked again ``retries`` times; after that the batch gives no
    entries, so the next run asks once more. Result: ``ip, host, ttl``."""
    import pandas as pd

    now = now if now is not None else utc_now()

    def ask(addresses):
        for _ in range(retries + 1):
            with contextlib.suppress(Exception):
                return resolver(addresses)
        return None

    def run(batches):
        for pdf in batches:
            names = ask(pdf["ip_text"].tolist())
            if names is not None:
                host = pd.Series(names, index=pdf.index, dtype=object)
                yield pd.DataFrame({"ip": pdf["ip"], "host": host.where(host.notna(), pdf["ip_text"])})

    missing = missing.select("ip").checkpoint(eager=True)
    tasks = max(1, min(parallel, -(-missing.count() // LOOKUPS)))
    texts = missing.repartition(tasks).select("ip", long_to_ip("ip").alias("ip_text"))
    named = texts.mapInPandas(run, "ip long, host string").withColumn("ttl", ntz_literal(now))
    # Written once: every address is looked up exactly once even though the
    # upsert reads the result twice (and a retried task would repeat lookups).
    return named.checkpoint(eager=True)


def upsert_hosts(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Replace-by-address: entries of ``new`` win; within ``new`` the latest
    ``ttl`` (then the largest host) wins. Write the result to a new snapshot,
    never over the data being read."""
    latest = new.groupBy("ip").agg(F.max_by(F.struct("ttl", "host"), F.struct("ttl", "host")).alias("_v"))
    latest = latest.select("ip", F.col("_v.host").alias("host"), F.col("_v.ttl").alias("ttl"))
    return cache.select("ip", "host", "ttl").join(latest.select("ip"), "ip", "left_anti").unionByName(latest)


def prune_hosts(cache: DataFrame, hours: int = PRUNE_MAX_AGE_HOURS, now=None) -> DataFrame:
    """Drop entries written strictly before ``now - hours``; NULL times stay."""
    if not isinstance(hours, int) or hours < 0:
        raise ValueError("prune age must be a number of hours, 0 or more")
    now = now if now is not None else utc_now()
    return cache.where(survives_prune("ttl", now, hours))


def dump_hosts(cache: DataFrame) -> DataFrame:
    """Dotted address and host ordered by address; failed lookups hidden."""
    return (cache.where(F.col("host") != long_to_ip("ip")).orderBy("ip")
                 .select(long_to_ip("ip").alias("ip"), "host"))


def host_dump_text(cache: DataFrame) -> DataFrame:
    """The dump as printed: address right-aligned to 20, host left-aligned to 50."""
    return dump_hosts(cache).select("ip", F.format_string(HOST_DUMP_FORMAT, "ip", "host").alias("line"))
