"""

Every query reads the driver's tables at ``sf_dir``: a syslog text log is
rendered from ``events`` (one line per event, FIXTURES.md §5), parsed back by
the library and analysed; the host table comes from ``customer``. The oracle
SQL computes the expected columns straight from ``events``/``customer`` with
integer formulas, so it shares nothing with the parser.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.functions import ip_to_long, long_to_ip, trim_host
from packetlog.operators import reports as R
from packetlog.plans import testdata as TD
from packetlog.plans.ingest import import_summary, parse_log
from packetlog.operators.parse import packets
from packetlog.sources.fixtures import FIXTURE_NOW, FIXTURE_YEAR
from packetlog.operators import feed as FD
from packetlog.operators import hosts as H
from packetlog.operators import render as RT
from packetlog.plans.store import import_log_to_path
from packetlog.session import scratch_path
from packetlog.streaming.follow import follow, follow_file, read_feed

# The corpus operators are an optional part: where they can't be imported, the rest works.
def _optional(name: str):
    try:
        return importlib.import_module(name)
    except ImportError:  # its files, or a package that only it needs
        return None


LLM = _optional("packetlog.llm.queries")
PIPELINE = _optional("corpus_pipeline") if LLM else None

SF_SMOKE = "/root/testdata/sf0.001"
REPORT_LIMIT = 1000  # the largest limit the tool accepts: checks whole top lists


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: denied traffic by source (R1, default limit) on sf0.001."""
    return R.denied_sources(TD.fixture_logs(spark, SF_SMOKE))


# ---------------------------------------------------------------- queries

def _parse_packets(spark, sf):
    parsed = parse_log(TD.fixture_lines(spark, sf), year=FIXTURE_YEAR)
    return packets(parsed).select("id", "if_in", "if_out", "src_ip", "src_prt", "dst_ip", "dst_prt",
                                  "proto", "action", "mac")


def _packet_event_time(spark, sf):
    return TD.fixture_logs(spark, sf).select("id", F.col("timestamp").alias("event_time"))


def _packet_event_time_auto(spark, sf):
    """Times of a log of three years, from the order of its lines and the time of its
    last change; the events are spread over those years, in their order."""
    import uuid
    from packetlog.plans.ingest import packets_from_log
    from packetlog.sources import read_syslog
    from packetlog.sources.fixtures import render_syslog
    root, events = scratch_path(spark, "years", uuid.uuid4().hex), spark.read.parquet(f"{sf}/events.parquet")
    end = events.agg(F.max("event_id")).first()[0] + 1
    after = F.floor(F.col("event_id") * 100_000_000 / F.lit(end)).cast("decimal(18,6)")
    zero = F.lit(0)
    spread = events.withColumn("ts", F.lit("2022-01-10").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, after))
    render_syslog(spread).repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select("value").write.text(root)
    changed = spread.agg(F.max("ts").alias("t")).first()["t"]
    lines = read_syslog(spark, root).withColumn("file_modification_time", F.lit(str(changed)).cast("timestamp_ntz"))
    return packets_from_log(lines, year="order").select("id", F.col("timestamp").alias("event_time"))


def _packet_ids(spark, sf):
    logs = TD.fixture_logs(spark, sf)
    return logs.agg(F.count(F.lit(1)).alias("packets"), F.min("id").alias("min_id"),
                    F.max("id").alias("max_id"), F.count_distinct("id").alias("distinct_ids"))


def _import_summary(spark, sf):
    return import_summary(TD.fixture_lines(spark, sf))


def _report(name):
    def run(spark, sf):
        return R.report(TD.fixture_logs(spark, sf), name, REPORT_LIMIT)
    return run


def _analysis_all(spark, sf):
    return R.analysis_union(TD.fixture_logs(spark, sf), REPORT_LIMIT, use_rollup=True)


def _packet_rollup(spark, sf):
    r = R.packet_rollup(TD.fixture_logs(spark, sf))
    return r.select(*R.ROLLUP_KEYS, "count", "min_id", F.col("src_prt").alias("rep_src_prt"),
                    F.col("dst_ip").alias("rep_dst_ip"))


def _ip_functions(spark, sf):
    # Addresses as text (from the rendered log) -> numbers -> text again.
    lines = TD.fixture_lines(spark, sf)
    src = F.regexp_extract("value", r" SRC=([^ ]+)", 1)
    df = lines.where(F.col("value").contains("IPT: ")).select(src.alias("ip_text"))
    return df.select("ip_text", ip_to_long("ip_text").alias("ip"),
                     long_to_ip(ip_to_long("ip_text")).alias("ip_back"))


def _trim_host(spark, sf):
    hosts = TD.fixture_hosts(spark, sf)
    return hosts.select("ip", "host", trim_host("host", 25).alias("host25"),
                        trim_host("host", 30).alias("host30"), trim_host("host", 12).alias("host12"))


def _report_with_hosts(spark, sf):
    rep = R.denied_sources(TD.fixture_logs(spark, sf), REPORT_LIMIT, numeric_ips=True)
    named = H.name_report(rep, TD.fixture_hosts(spark, sf), now=FIXTURE_NOW)
    return named.select("count", long_to_ip("src_ip").alias("src_ip"), "src_ip_name", "src_prt",
                        long_to_ip("dst_ip").alias("dst_ip"), "dst_ip_name", "dst_prt", "proto", "action")


def _feed_with_hosts(max_broadcast, hot_keys=H.HOT_KEYS):
    def run(spark, sf):
        feed = FD.scan_feed(TD.fixture_logs(spark, sf), numeric_ips=True)
        named = H.name_feed(feed, TD.fixture_hosts(spark, sf), now=FIXTURE_NOW, row_key="packet_no",
                            max_broadcast=max_broadcast, hot_keys=hot_keys)
        return named.select("packet_no", "iface", long_to_ip("src_ip").alias("src_ip"), "src_ip_name", "src_prt",
                            long_to_ip("dst_ip").alias("dst_ip"), "dst_ip_name", "dst_prt", "proto", "action")
    return run


def _hosts_to_resolve(spark, sf):
    missing = H.hosts_to_resolve(TD.fixture_logs(spark, sf), TD.fixture_hosts(spark, sf), now=FIXTURE_NOW)
    return missing.select(long_to_ip("ip").alias("ip"))


def _test_resolver(addresses):
    """Caller-side resolver used by the checks: names the 188.126.93.x
    addresses, fails every other lookup."""
    return [f"gw{a.rsplit('.', 1)[1]}.example.net" if a.startswith("188.126.93.") else None for a in addresses]


def _host_cache_upsert(spark, sf):
    cache = TD.fixture_hosts(spark, sf)
    missing = H.hosts_to_resolve(TD.fixture_logs(spark, sf), cache, now=FIXTURE_NOW)
    new = H.resolve_hosts(missing, _test_resolver, now=FIXTURE_NOW)
    return H.upsert_hosts(cache, new).select(long_to_ip("ip").alias("ip"), "host", "ttl")


def _host_cache_prune(spark, sf):
    pruned = H.prune_hosts(TD.fixture_hosts(spark, sf), H.PRUNE_MAX_AGE_HOURS, now=FIXTURE_NOW)
    return pruned.select(long_to_ip("ip").alias("ip"), "host", "ttl")


def _host_cache_dump(spark, sf):
    return H.dump_hosts(TD.fixture_hosts(spark, sf))


def _block_list(spark, sf):
    return FD.block_list(TD.fixture_logs(spark, sf), 23, "TCP")


def _scan_feed(spark, sf):
    return FD.scan_feed(TD.fixture_logs(spark, sf))


def _scan_feed_filtered(spark, sf):
    return FD.scan_feed(TD.fixture_logs(spark, sf), no_lo=True, no_accept=True)


def _scan_feed_text(spark, sf):
    return RT.feed_text(FD.scan_feed(TD.fixture_logs(spark, sf)))


def _analysis_text(spark, sf):
    logs = TD.fixture_logs(spark, sf)
    parts = []
    for name, rep in R.analysis(logs, REPORT_LIMIT, with_rank=True).items():
        parts.append(RT.report_text(rep, name).select(F.lit(name).alias("report"), "rank", "line"))
    from functools import reduce
    return reduce(DataFrame.unionByName, parts)


def _id_summary(df):
    return df.groupBy("action").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("min_id"),
                                    F.max("id").alias("max_id"), F.count_distinct("id").alias("distinct_ids"))


def _import_append_twice(spark, sf):
    import uuid
    path = scratch_path(spark, "imports", uuid.uuid4().hex)
    lines = TD.fixture_lines(spark, sf)
    import_log_to_path(spark, lines, path)
    import_log_to_path(spark, lines, path)
    return _id_summary(spark.read.parquet(path))


def _clear_then_import(spark, sf):
    import uuid
    from packetlog.plans import store
    root = scratch_path(spark, "imports", "a table " + uuid.uuid4().hex)
    lines = TD.fixture_lines(spark, sf)
    store.import_packets(spark, lines, root)
    store.import_packets(spark, lines, root)
    store.import_packets(spark, lines, root, clear=True)
    return _id_summary(store.read_packets(spark, root))


def _import_versions(spark, sf):
    """Two imports into the versioned packet table, a clear, two more: ids and rows."""
    import uuid
    from packetlog.plans import store
    root = scratch_path(spark, "imports", uuid.uuid4().hex)
    lines = TD.fixture_lines(spark, sf)
    for step in ("import", "import", "clear", "import", "import"):
        store.clear_packets(spark, root) if step == "clear" else store.import_packets(spark, lines, root)
    return _id_summary(store.read_packets(spark, root))


def _log_in_three_parts(spark, sf):
    """Folder of a log in three parts, from the oldest: c, b, a."""
    import uuid
    from packetlog.sources.fixtures import render_syslog
    root, events = scratch_path(spark, "rotated", uuid.uuid4().hex), spark.read.parquet(f"{sf}/events.parquet")
    end = events.agg(F.max("event_id")).first()[0] + 1
    for k, name in enumerate("cba"):
        part = events.where(F.floor(F.col("event_id") * 3 / F.lit(end)) == k)
        render_syslog(part).repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("value").write.text(f"{root}/{name}")
    return root


def _analysis_incremental(spark, sf):
    """The six reports from the stored roll-ups of three imports, after an import that
    was cleared; two of the roll-ups are merged before the third import."""
    import uuid
    from packetlog.plans import store
    from packetlog.sources import read_syslog
    log, root = _log_in_three_parts(spark, sf), scratch_path(spark, "imports", uuid.uuid4().hex)
    load = lambda name: store.import_packets(spark, read_syslog(spark, f"{log}/{name}"), root, rollup=True)
    load("a")
    store.clear_packets(spark, root)
    load("c")
    load("b")
    store.packet_table(spark, root, rollup=True).merge_derived(R.merge_rollups)
    load("a")
    return R.union_reports(R.analysis_from_rollup(store.read_rollup(spark, root), REPORT_LIMIT, with_rank=True))


def _analysis_stored_auto(spark, sf):
    """The six reports of a table of three imports, each of which stored its roll-up
    only if the sketch of its keys said that it pays."""
    import uuid
    from packetlog.plans import store
    from packetlog.sources import read_syslog
    log, root = _log_in_three_parts(spark, sf), scratch_path(spark, "imports", uuid.uuid4().hex)
    for name in "cba":
        store.import_packets(spark, read_syslog(spark, f"{log}/{name}"), root, rollup="auto")
    return R.union_reports(store.stored_analysis(spark, root, REPORT_LIMIT, with_rank=True))


def _import_rejects(spark, sf):
    """Summary and rejected lines of an import in which the marker of some lines is
    glued to the word before, so that it is no token."""
    import uuid
    from packetlog.plans import store
    from packetlog.sources import read_syslog
    from packetlog.sources.fixtures import render_syslog
    root, events = scratch_path(spark, "rejects", uuid.uuid4().hex), spark.read.parquet(f"{sf}/events.parquet")
    lines = render_syslog(events).withColumn("value", F.when(F.col("event_id") % 13 == 0, F.replace("value", F.lit(" IPT: "), F.lit(" xIPT: "))).otherwise(F.col("value")))
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(f"{root}/log")
    total = store.import_packets(spark, read_syslog(spark, f"{root}/log"), f"{root}/table", rejects_path=f"{root}/rejected")
    stored = store.read_packets(spark, f"{root}/table").agg(F.count(F.lit(1)).alias("stored"), F.max("id").alias("max_id"))
    # After " kernel: [" comes the event's number.
    number = F.regexp_extract("line", r" kernel: \[(\d+)\.", 1).cast("bigint")
    kept = spark.read.parquet(f"{root}/rejected").agg(F.count(F.lit(1)).alias("rejected_lines"), F.sum(number).alias("sum_of_numbers"))
    parts = [df.unpivot([], df.columns, "what", "n") for df in (total, stored, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _follow_arrival(spark, sf):
    """Whether each packet of a feed arrived between its start and its end."""
    import datetime as dt
    from packetlog.sources.fixtures import fixture_log_path
    started = dt.datetime.now(dt.timezone.utc)
    query, sink = follow(spark, fixture_log_path(spark, sf), from_start=True, available_now=True)
    query.awaitTermination()
    ended = dt.datetime.now(dt.timezone.utc)
    return read_feed(spark, sink).select(F.col("id").alias("packet_no"), F.col("arrival").between(F.lit(started), F.lit(ended)).alias("in_time"))


def _packet_ids_by_list(spark, sf):
    """Ids of a log in three parts, given oldest first under names that sort the
    other way, and the newest part once more."""
    from packetlog.plans.ingest import packets_from_log
    from packetlog.sources import read_syslog
    root = _log_in_three_parts(spark, sf)
    lines = read_syslog(spark, [f"{root}/{name}" for name in "cbaa"])
    return packets_from_log(lines, year=FIXTURE_YEAR).select("id", F.col("timestamp").alias("event_time"), "src_prt")


def _report_resolved_hosts(spark, sf):
    import uuid
    from packetlog.plans import store
    from packetlog.plans.naming import name_reports_through
    root = scratch_path(spark, "hosts", uuid.uuid4().hex)
    store.write_host_table(spark, root, TD.fixture_hosts(spark, sf))
    rep = R.denied_sources(TD.fixture_logs(spark, sf), REPORT_LIMIT, numeric_ips=True)
    named = name_reports_through({"r": rep}, spark, root, _test_resolver, FIXTURE_NOW)["r"]
    return named.select("count", long_to_ip("src_ip").alias("src_ip"), "src_ip_name", "src_prt",
                        long_to_ip("dst_ip").alias("dst_ip"), "dst_ip_name", "dst_prt", "proto", "action")


def _host_table_cycle(spark, sf):
    """The stored host table after an upsert that replaces and adds, and a prune."""
    import uuid
    from packetlog.functions.eventtime import ntz_literal
    from packetlog.plans import store
    root, cache = scratch_path(spark, "hosts", uuid.uuid4().hex), TD.fixture_hosts(spark, sf)
    store.write_host_table(spark, root, cache)
    renamed = cache.where(F.col("ip") % 7 == 0).select("ip", F.concat(F.lit("renamed-"), F.col("ip").cast("string")).alias("host"), ntz_literal(FIXTURE_NOW).alias("ttl"))
    missing = H.hosts_to_resolve(TD.fixture_logs(spark, sf), cache, now=FIXTURE_NOW)
    store.upsert_host_table(spark, root, H.resolve_hosts(missing, _test_resolver, now=FIXTURE_NOW))
    store.upsert_host_table(spark, root, renamed)
    store.prune_host_table(spark, root, H.PRUNE_MAX_AGE_HOURS, FIXTURE_NOW)
    return store.read_host_table(spark, root).select(long_to_ip("ip").alias("ip"), "host", "ttl")


def _scan_feed_limit(spark, sf):
    """The first 40 per cent of the packets, by the id of the last one wanted."""
    logs = TD.fixture_logs(spark, sf)
    wanted = int(logs.count() * 0.4)
    last = FD.nth_id(logs, wanted)
    return FD.scan_feed(logs.where(F.col("id") <= last))


def _catalog_cycle(spark, sf):
    """Create, list, import, clear, import again and drop a catalog table: the
    number of rows after each step."""
    import uuid
    from packetlog.plans import store
    from packetlog.sources.fixtures import fixture_log_path
    name, log = "packets_" + uuid.uuid4().hex, fixture_log_path(spark, sf)
    store.create_table(spark, name, path=scratch_path(spark, "tables", name))
    size = lambda: spark.table(name).count()
    steps = [("created", size()), ("listed", store.list_tables(spark).where(F.col("name") == name).count())]
    for step, run in (("imported", lambda: store.import_log(spark, log, name)), ("appended", lambda: store.import_log(spark, log, name)),
                      ("cleared", lambda: store.clear_table(spark, name)), ("imported again", lambda: store.import_log(spark, log, name)),
                      ("clear then import", lambda: store.import_log(spark, log, name, clear=True))):
        run()
        steps.append((step, size()))
    store.drop_table(spark, name)
    steps.append(("dropped", store.list_tables(spark).where(F.col("name") == name).count()))
    return spark.createDataFrame(steps, "step string, n long")


def _feed_text_full(spark, sf):
    feed = FD.scan_feed(TD.fixture_logs(spark, sf), no_lo=True, no_accept=True)
    return RT.feed_lines(feed).select("line_no", "packet_no", "line")


def _host_lookup(spark, sf):
    logs = TD.fixture_logs(spark, sf)
    found = H.lookup_hosts(TD.fixture_hosts(spark, sf), logs.select("id", "src_ip"), "src_ip", now=FIXTURE_NOW)
    return found.select("id", long_to_ip("src_ip").alias("src_ip"), "host")


def _host_dump_text(spark, sf):
    return H.host_dump_text(TD.fixture_hosts(spark, sf))


def _host_cache_clear(spark, sf):
    """Rows of the stored host table after a write, a second one and a clear."""
    import uuid
    from packetlog.plans import store
    root, cache = scratch_path(spark, "hosts", uuid.uuid4().hex), TD.fixture_hosts(spark, sf)
    steps = [("empty", store.read_host_table(spark, root).count())]
    for step, run in (("written", lambda: store.write_host_table(spark, root, cache)),
                      ("pruned", lambda: store.write_host_table(spark, root, H.prune_hosts(store.read_host_table(spark, root), 100, now=FIXTURE_NOW))),
                      ("cleared", lambda: store.clear_host_table(spark, root))):
        run()
        steps.append((step, store.read_host_table(spark, root).count()))
    return spark.createDataFrame(steps, "step string, n long")


def _follow_feed(spark, sf):
    from packetlog.sources.fixtures import fixture_log_path
    query, sink = follow(spark, fixture_log_path(spark, sf), from_start=True, available_now=True)
    query.awaitTermination()
    return FD.scan_feed(read_feed(spark, sink).withColumnRenamed("packet_no", "id"))


def _append_to(path: str, folder: str) -> None:
    """Append the text files of a folder, in the order of their names, to one file."""
    import shutil
    from pyarrow.fs import FileSelector
    from packetlog.streaming.tail import file_system
    (store, plain), (_, parts) = file_system(path), file_system(folder)
    store.create_dir(plain.rsplit("/", 1)[0])
    files = sorted(i.path for i in store.get_file_info(FileSelector(parts)) if i.base_name.startswith("part-"))
    with store.open_append_stream(plain) as out:
        for name in files:
            with store.open_input_stream(name) as part:
                shutil.copyfileobj(part, out, 1 << 20)


def _follow_growing(spark, sf):
    """The feed of a growing log file: begun at the end of its first third, stopped
    and started again after the second was appended and the file was then rotated, and
    once more after the third was appended to the new file."""
    from packetlog.session import rename_path
    parts = _log_in_three_parts(spark, sf)
    log, sink = f"{parts}/live/fw.log", f"{parts}/sink"
    for name in "cba":
        _append_to(log, f"{parts}/{name}")
        query, _ = follow_file(spark, log, sink=sink, available_now=True, split_bytes=1 << 18)
        query.awaitTermination()
        if name == "b":
            rename_path(spark, log, log + ".1")
    return FD.scan_feed(read_feed(spark, sink).withColumnRenamed("packet_no", "id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "parse_packets": _parse_packets,
        "packet_event_time": _packet_event_time,
        "packet_event_time_auto": _packet_event_time_auto,
        "packet_ids": _packet_ids,
        "import_summary": _import_summary,
        "analysis_all": _analysis_all,
        "analysis_incremental": _analysis_incremental,
        "analysis_stored_auto": _analysis_stored_auto,
        "import_rejects": _import_rejects,
        "follow_arrival": _follow_arrival,
        "packet_rollup": _packet_rollup,
        "ip_functions": _ip_functions,
        "trim_host": _trim_host,
        "report_with_hosts": _report_with_hosts,
        "feed_with_hosts": _feed_with_hosts(H.MAX_BROADCAST_HOSTS),
        # Skew-safe shuffle path; a short hot list so both the hot (broadcast)
        # and the cold (shuffled) addresses occur at the test scales.
        "feed_with_hosts_shuffle": _feed_with_hosts(0, hot_keys=10),
        "hosts_to_resolve": _hosts_to_resolve,
        "host_cache_upsert": _host_cache_upsert,
        "host_cache_prune": _host_cache_prune,
        "host_cache_dump": _host_cache_dump,
        "block_list": _block_list,
        "scan_feed": _scan_feed,
        "scan_feed_filtered": _scan_feed_filtered,
        "scan_feed_text": _scan_feed_text,
        "analysis_text": _analysis_text,
        "import_append_twice": _import_append_twice,
        "clear_then_import": _clear_then_import,
        "import_versions": _import_versions,
        "packet_ids_by_list": _packet_ids_by_list,
        "report_resolved_hosts": _report_resolved_hosts,
        "host_table_cycle": _host_table_cycle,
        "scan_feed_limit": _scan_feed_limit,
        "follow_feed": _follow_feed,
        "follow_growing": _follow_growing,
        "catalog_cycle": _catalog_cycle,
        "feed_text_full": _feed_text_full,
        "host_lookup": _host_lookup,
        "host_dump_text": _host_dump_text,
        "host_cache_clear": _host_cache_clear,
    }
    for name in R.REPORT_ORDER:
        q[name] = _report(name)
    if LLM:
        q.update(LLM.QUERIES)
    if PIPELINE:
        q["pipeline"] = PIPELINE.run
    return q


# ---------------------------------------------------------------- oracle

def _dotted(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE CAST(({x} >> 24) & 255 AS VARCHAR) || '.' || "
            f"CAST(({x} >> 16) & 255 AS VARCHAR) || '.' || CAST(({x} >> 8) & 255 AS VARCHAR) || '.' || "
            f"CAST({x} & 255 AS VARCHAR) END")


# Fixed value: the MAC field of the rendered lines.
_MAC = "02:00:bc:7e:5d:a0:00:13:5f:21:29:40:08:00"

# Expected packet table, straight from events (no text involved). Every event
# is rendered as one log line; every 101st one is an ordinary kernel line
# without the marker, which the parser skips: so the packets are the events with
# event_id % 101 <> 0 (a property of the fixture, not a sample).
_PACKETS = f"""
ev AS (
  SELECT event_id AS e, user_id AS u, ts, event_type,
         ((CAST(json_extract_string(props, '$.k') AS BIGINT) % 8) + 8) % 8 AS k8
  FROM events
),
packets AS (
  SELECT
    CAST(row_number() OVER (ORDER BY e) AS BIGINT) AS id,
    e,
    CAST(date_trunc('second', ts) AS TIMESTAMP) AS event_time,
    CASE WHEN e % 17 = 0 THEN 'lo' WHEN e % 5 = 0 THEN '' ELSE 'eth' || CAST(e % 2 AS VARCHAR) END AS if_in,
    CASE WHEN e % 19 = 0 THEN 'lo' WHEN e % 5 = 0 THEN 'eth0' ELSE '' END AS if_out,
    CAST(CASE WHEN u < 65536 THEN CAST(203 AS BIGINT) * 16777216 + u END AS BIGINT) AS src_ip,
    CAST(CASE WHEN e % 20 = 0 THEN 53 WHEN e % 10 = 0 THEN 0 ELSE 1024 + (e * 7919) % 60000 END AS BIGINT) AS src_prt,
    CAST(CASE WHEN e % 20 = 0 THEN CAST(9 AS BIGINT) * 16777216 + 9 * 65536 + 9 * 256 + 9
              ELSE CAST(188 AS BIGINT) * 16777216 + 126 * 65536 + 93 * 256 + e % 4 END AS BIGINT) AS dst_ip,
    CAST(CASE WHEN e % 20 = 0 THEN 33434 WHEN e % 10 = 0 THEN 0
              ELSE [80, 25, 445, 110, 23, 5087, 137, 53][k8 + 1] END AS BIGINT) AS dst_prt,
    CASE WHEN e % 20 = 0 THEN 'UDP' WHEN e % 10 = 0 THEN 'ICMP' WHEN e % 10 < 4 THEN 'UDP' ELSE 'TCP' END AS proto,
    CASE WHEN e % 103 = 0 THEN 'DROP' WHEN event_type = 'error' THEN 'INVALID'
         WHEN event_type = 'purchase' THEN 'DROP' WHEN event_type = 'signup' THEN 'CBLK' ELSE 'ACCEPT' END AS action,
    '{_MAC}' AS mac
  FROM ev WHERE e % 101 <> 0
)"""

_DENIED = "action <> 'ACCEPT' AND if_in <> 'lo' AND if_out <> 'lo'"
_REPORT_SQL = {
    "denied_sources": (_DENIED, ["src_ip", "dst_prt", "action", "proto"], ["src_prt", "dst_ip"],
                       ["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action"]),
    "icmp_traffic": ("proto = 'ICMP' AND if_in <> 'lo' AND if_out <> 'lo'",
                     ["src_ip", "dst_prt", "action", "proto"], ["dst_ip"], ["count", "src_ip", "dst_ip", "action"]),
    "denied_ports": (_DENIED, ["dst_prt", "action", "proto"], [], ["count", "dst_prt", "proto", "action"]),
    "invalid_sources": ("action = 'INVALID' AND if_in <> 'lo' AND if_out <> 'lo'",
                        ["src_ip", "dst_prt", "proto"], ["src_prt", "dst_ip"],
                        ["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto"]),
    "interface_stats": ("action <> 'ACCEPT'", ["if_in", "action", "proto"], [], ["count", "if_in", "action", "proto"]),
    "inbound_port_actions": ("if_in <> 'lo' AND if_in <> '' AND action <> 'ACCEPT'", ["dst_prt", "action"], [],
                             ["count", "dst_prt", "action"]),
}


def _report_body(name: str, limit: int, rank: bool = False, numeric: bool = False) -> str:
    where, keys, rep, out = _REPORT_SQL[name]
    reps = "".join(f", arg_min({c}, id) AS {c}" for c in rep)
    order = "count DESC, " + ", ".join(f"{k} ASC NULLS FIRST" for k in keys)
    sel = []
    for c in out:
        sel.append(f"{_dotted(c)} AS {c}" if c in ("src_ip", "dst_ip") and not numeric else c)
    if rank:
        sel.insert(0, f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank")
    return (f"SELECT {', '.join(sel)} FROM (SELECT {', '.join(keys)}, CAST(count(*) AS BIGINT) AS count{reps} "
            f"FROM packets WHERE {where} GROUP BY {', '.join(keys)} ORDER BY {order} LIMIT {limit}) t")


def _with(body: str) -> str:
    return f"WITH {_PACKETS}\n{body}"


def _analysis_all_sql() -> str:
    cols = ["rank", "count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action", "if_in"]
    types = {"rank": "INTEGER", "count": "BIGINT", "src_prt": "BIGINT", "dst_prt": "BIGINT"}
    parts = []
    for name in R.REPORT_ORDER:
        out = ["rank"] + _REPORT_SQL[name][3]
        sel = [f"'{name}' AS report"] + [c if c in out else f"CAST(NULL AS {types.get(c, 'VARCHAR')}) AS {c}"
                                         for c in cols]
        parts.append(f"SELECT {', '.join(sel)} FROM ({_report_body(name, REPORT_LIMIT, rank=True)}) r_{name}")
    return _with("\nUNION ALL\n".join(parts))


def oracle_sql() -> dict[str, str]:
    o = {
        "parse_packets": _with("SELECT id, if_in, if_out, src_ip, src_prt, dst_ip, dst_prt, proto, action, mac FROM packets"),
        "packet_event_time": _with("SELECT id, event_time FROM packets"),
        "packet_event_time_auto": _with("SELECT id, CAST(TIMESTAMP '2022-01-10' + to_seconds(CAST(floor(e * 100000000 / (SELECT max(event_id) + 1 "
                                        "FROM events)) AS BIGINT)) AS TIMESTAMP) AS event_time FROM packets"),
        "packet_ids": _with("SELECT CAST(count(*) AS BIGINT) AS packets, min(id) AS min_id, max(id) AS max_id, "
                            "CAST(count(DISTINCT id) AS BIGINT) AS distinct_ids FROM packets"),
        "import_summary": ("SELECT CAST(count(*) AS BIGINT) AS lines_read, "
                           "CAST(count(*) FILTER (WHERE event_id % 101 <> 0) AS BIGINT) AS marker_lines, "
                           "CAST(count(*) FILTER (WHERE event_id % 101 <> 0) AS BIGINT) AS parsed, "
                           "CAST(0 AS BIGINT) AS rejected FROM events"),
        "analysis_all": _analysis_all_sql(),
        "analysis_incremental": _analysis_all_sql(),
        "analysis_stored_auto": _analysis_all_sql(),
        "import_rejects": _with(
            "SELECT v.what, CAST(v.n AS BIGINT) AS n FROM (SELECT count(*) AS m, count(*) FILTER (WHERE e % 13 <> 0) AS p, "
            "max(id) FILTER (WHERE e % 13 <> 0) AS x, sum(e) FILTER (WHERE e % 13 = 0) AS s FROM packets) t, "
            "LATERAL (VALUES ('lines_read', (SELECT count(*) FROM events)), ('marker_lines', m), ('parsed', p), ('rejected', m - p), "
            "('stored', p), ('max_id', x), ('rejected_lines', m - p), ('sum_of_numbers', s)) v(what, n)"),
        "follow_arrival": _with("SELECT id AS packet_no, true AS in_time FROM packets"),
        "packet_rollup": _with("SELECT if_in, if_out, src_ip, dst_prt, proto, action, CAST(count(*) AS BIGINT) AS count, "
                               "min(id) AS min_id, arg_min(src_prt, id) AS rep_src_prt, arg_min(dst_ip, id) AS rep_dst_ip "
                               "FROM packets GROUP BY ALL"),
        "ip_functions": ("SELECT '203.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip_text, "
                         "CAST(CAST(203 AS BIGINT) * 16777216 + user_id AS BIGINT) AS ip, "
                         "'203.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip_back "
                         "FROM events WHERE event_id % 101 <> 0"),
        "trim_host": f"""WITH h AS ({_HOSTS_SQL})
            SELECT ip, host,
              CASE WHEN length(host) > 25 THEN '*' || right(host, 24) ELSE host END AS host25,
              CASE WHEN length(host) > 30 THEN '*' || right(host, 29) ELSE host END AS host30,
              CASE WHEN length(host) > 12 THEN '*' || right(host, 11) ELSE host END AS host12
            FROM h""",
    }
    for name in R.REPORT_ORDER:
        o[name] = _with(_report_body(name, REPORT_LIMIT))
    o.update(_more_oracles())
    if LLM:
        o.update(LLM.ORACLE_SQL)
    if PIPELINE and PIPELINE.ORACLE_SQL:
        o["pipeline"] = PIPELINE.ORACLE_SQL
    return o


_HOSTS_SQL = ("SELECT CAST(CAST(203 AS BIGINT) * 16777216 + c_custkey AS BIGINT) AS ip, "
              "CASE WHEN c_custkey % 4 = 0 THEN '203.0.' || CAST(c_custkey // 256 AS VARCHAR) || '.' || "
              "CAST(c_custkey % 256 AS VARCHAR) ELSE 'host-' || CAST(c_custkey AS VARCHAR) || '.cust.provider.example.org' END AS host, "
              "CAST(TIMESTAMP '2024-01-31 00:00:00' - (c_custkey % 400) * INTERVAL 1 HOUR AS TIMESTAMP) AS ttl "
              "FROM customer")


_FRESH = "fresh AS (SELECT ip, host FROM h WHERE ttl > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 300 HOUR)"


def _trim(x: str, width: int) -> str:
    return f"CASE WHEN length({x}) > {width} THEN '*' || right({x}, {width - 1}) ELSE {x} END"


def _hosts_with(body: str) -> str:
    return f"WITH {_PACKETS},\nh AS ({_HOSTS_SQL}),\n{_FRESH}\n{body}"


_FEED_COLS = ("id AS packet_no, CASE WHEN if_in <> '' THEN if_in ELSE if_out END AS iface, "
              "{src} AS src_ip, src_prt, {dst} AS dst_ip, dst_prt, proto, action")
_FEED_SQL = "SELECT " + _FEED_COLS.format(src=_dotted("src_ip"), dst=_dotted("dst_ip")) + " FROM packets"
_ID_SUMMARY = ("SELECT action, CAST(count(*) * {k} AS BIGINT) AS count, min(id) AS min_id, "
               "max(id) + {shift} AS max_id, CAST(count(*) * {k} AS BIGINT) AS distinct_ids FROM packets GROUP BY action")

# The feed's printed header (a blank line, then two lines).
_FEED_TOP = ("chr(10) || 'Count    IF       Source                          Port Destination                     Port Proto      Action    ' || chr(10) || "
             "'-------- -------- ------------------------------ ----- ------------------------------ ----- ---------- ----------' || chr(10)")

# The printed row formats.
_REPORT_FMT = {
    "denied_sources": ("'%6d %-25s %5d %-25s %5d %-6s %-10s'", ["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto", "action"]),
    "icmp_traffic": ("'%6d %-25s %-25s %-10s'", ["count", "src_ip", "dst_ip", "action"]),
    "denied_ports": ("'%6d    %5d   %-6s   %-10s'", ["count", "dst_prt", "proto", "action"]),
    "invalid_sources": ("'%6d   %-25s   %5d   %-25s   %5d   %-6s   '", ["count", "src_ip", "src_prt", "dst_ip", "dst_prt", "proto"]),
    "interface_stats": ("'%6d   %-10s   %-10s   %-6s   '", ["count", "if_in", "action", "proto"]),
    "inbound_port_actions": ("'%6d   %5d   %-10s   '", ["count", "dst_prt", "action"]),
}


def _analysis_text_sql() -> str:
    parts = []
    for name in R.REPORT_ORDER:
        fmt, cols = _REPORT_FMT[name]
        parts.append(f"SELECT '{name}' AS report, rank, printf({fmt}, {', '.join(cols)}) AS line "
                     f"FROM ({_report_body(name, REPORT_LIMIT, rank=True)}) r_{name}")
    return _with("\nUNION ALL\n".join(parts))


def _more_oracles() -> dict[str, str]:
    feed_named = ("SELECT p.packet_no, p.iface, p.src_ip, coalesce(" + _trim("fs.host", 30) + ", p.src_ip) AS src_ip_name, "
                  "p.src_prt, p.dst_ip, coalesce(" + _trim("fd.host", 30) + ", p.dst_ip) AS dst_ip_name, p.dst_prt, p.proto, p.action "
                  "FROM (SELECT " + _FEED_COLS.format(src="src_ip", dst="dst_ip") + " FROM packets) p "
                  "LEFT JOIN fresh fs ON fs.ip = p.src_ip LEFT JOIN fresh fd ON fd.ip = p.dst_ip")
    feed_named = feed_named.replace("SELECT p.packet_no, p.iface, p.src_ip,", "SELECT p.packet_no, p.iface, " + _dotted("p.src_ip") + " AS src_ip,")
    feed_named = feed_named.replace("p.src_prt, p.dst_ip,", "p.src_prt, " + _dotted("p.dst_ip") + " AS dst_ip,")
    feed_named = feed_named.replace(", p.src_ip) AS src_ip_name", ", " + _dotted("p.src_ip") + ") AS src_ip_name")
    feed_named = feed_named.replace(", p.dst_ip) AS dst_ip_name", ", " + _dotted("p.dst_ip") + ") AS dst_ip_name")
    report_named = (
        "SELECT r.count, " + _dotted("r.src_ip") + " AS src_ip, coalesce(" + _trim("fs.host", 25) + ", " + _dotted("r.src_ip")
        + ") AS src_ip_name, r.src_prt, " + _dotted("r.dst_ip") + " AS dst_ip, coalesce(" + _trim("fd.host", 25) + ", "
        + _dotted("r.dst_ip") + ") AS dst_ip_name, r.dst_prt, r.proto, r.action FROM ("
        + _report_body("denied_sources", REPORT_LIMIT, numeric=True)
        + ") r LEFT JOIN fresh fs ON fs.ip = r.src_ip LEFT JOIN fresh fd ON fd.ip = r.dst_ip")
    missing = ("missing AS (SELECT DISTINCT ip FROM (SELECT src_ip AS ip FROM packets UNION ALL SELECT dst_ip FROM packets) a "
               "WHERE ip IS NOT NULL AND ip NOT IN (SELECT ip FROM fresh))")
    new = ("new AS (SELECT ip, CASE WHEN ip >> 8 = (CAST(188 AS BIGINT) * 65536 + 126 * 256 + 93) "
           "THEN 'gw' || CAST(ip & 255 AS VARCHAR) || '.example.net' ELSE " + _dotted("ip") + " END AS host, "
           "TIMESTAMP '2024-01-31 00:00:00' AS ttl FROM missing)")
    n_packets = "(SELECT count(*) FROM packets)"
    return {
        "report_with_hosts": _hosts_with(report_named),
        "feed_with_hosts": _hosts_with(feed_named),
        "feed_with_hosts_shuffle": _hosts_with(feed_named),
        "hosts_to_resolve": _hosts_with(", " + missing + " SELECT " + _dotted("ip") + " AS ip FROM missing"),
        "host_cache_upsert": _hosts_with(", " + missing + ", " + new + " SELECT " + _dotted("ip") + " AS ip, host, ttl FROM "
                                         "(SELECT * FROM h WHERE ip NOT IN (SELECT ip FROM new) UNION ALL SELECT * FROM new) u"),
        "host_cache_prune": (f"WITH h AS ({_HOSTS_SQL}) SELECT {_dotted('ip')} AS ip, host, ttl FROM h "
                             "WHERE coalesce(ttl >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 336 HOUR, true)"),
        "host_cache_dump": f"WITH h AS ({_HOSTS_SQL}) SELECT {_dotted('ip')} AS ip, host FROM h WHERE host <> {_dotted('ip')}",
        "block_list": _with("SELECT " + _dotted("src_ip") + " AS src_ip, CAST(count(*) AS BIGINT) AS count, min(id) AS first_packet, "
                            "max(id) AS last_packet FROM packets WHERE dst_prt = 23 AND proto = 'TCP' GROUP BY src_ip"),
        "scan_feed": _with(_FEED_SQL),
        "scan_feed_filtered": _with(_FEED_SQL + " WHERE if_in <> 'lo' AND if_out <> 'lo' AND action <> 'ACCEPT'"),
        "scan_feed_text": _with("SELECT packet_no, printf('%8d %-8s %-30s %5d %-30s %5d %-10s %-10s', packet_no, iface, src_ip, "
                                "src_prt, dst_ip, dst_prt, proto, action) AS line FROM (" + _FEED_SQL + ") f"),
        "analysis_text": _analysis_text_sql(),
        "import_append_twice": _with(_ID_SUMMARY.format(k=2, shift=n_packets)),
        "clear_then_import": _with(_ID_SUMMARY.format(k=1, shift=0)),
        "import_versions": _with(_ID_SUMMARY.format(k=2, shift=n_packets)),
        "packet_ids_by_list": _with(
            "SELECT id, event_time, src_prt FROM packets UNION ALL SELECT " + n_packets + " + CAST(row_number() OVER (ORDER BY id) AS BIGINT), event_time, src_prt "
            "FROM packets WHERE e * 3 // (SELECT max(event_id) + 1 FROM events) = 2"),
        "report_resolved_hosts": _hosts_with(
            ", named AS (SELECT * FROM fresh UNION ALL SELECT ip, CASE WHEN ip >> 8 = (CAST(188 AS BIGINT) * 65536 + 126 * 256 + 93) "
            "THEN 'gw' || CAST(ip & 255 AS VARCHAR) || '.example.net' ELSE " + _dotted("ip") + " END FROM (SELECT DISTINCT ip FROM "
            "(SELECT src_ip AS ip FROM packets UNION ALL SELECT dst_ip FROM packets) a WHERE ip NOT IN (SELECT ip FROM fresh)) m)\n"
            + report_named.replace("JOIN fresh ", "JOIN named ")),
        "host_table_cycle": _hosts_with(
            ", " + missing + ", " + new + ", up AS (SELECT * FROM h WHERE ip NOT IN (SELECT ip FROM new) UNION ALL SELECT * FROM new), "
            "renamed AS (SELECT ip, 'renamed-' || CAST(ip AS VARCHAR) AS host, TIMESTAMP '2024-01-31 00:00:00' AS ttl FROM h WHERE ip % 7 = 0), "
            "merged AS (SELECT * FROM up WHERE ip NOT IN (SELECT ip FROM renamed) UNION ALL SELECT * FROM renamed) "
            "SELECT " + _dotted("ip") + " AS ip, host, ttl FROM merged WHERE coalesce(ttl >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 336 HOUR, true)"),
        "scan_feed_limit": _with(_FEED_SQL + " WHERE id <= CAST(floor((SELECT count(*) FROM packets) * 0.4) AS BIGINT)"),
        "follow_feed": _with(_FEED_SQL),
        "follow_growing": _with(_FEED_SQL.replace("FROM packets", "FROM (SELECT * REPLACE (CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS id) "
                                "FROM packets WHERE e * 3 // (SELECT max(event_id) + 1 FROM events) >= 1) later")),
        "catalog_cycle": _with("SELECT s.step, CAST(CASE WHEN s.k < 0 THEN -s.k - 1 ELSE s.k * " + n_packets + " END AS BIGINT) AS n "
                               "FROM (VALUES ('created', 0), ('listed', -2), ('imported', 1), ('appended', 2), ('cleared', 0), "
                               "('imported again', 1), ('clear then import', 1), ('dropped', 0)) s(step, k)"),
        "feed_text_full": _with(
            "SELECT line_no, packet_no, CASE WHEN (line_no - 1) % 20 = 0 THEN " + _FEED_TOP + " || line ELSE line END AS line FROM ("
            "SELECT CAST(row_number() OVER (ORDER BY packet_no) AS BIGINT) AS line_no, packet_no, printf('%8d %-8s %-30s %5d %-30s %5d %-10s %-10s', "
            "packet_no, iface, src_ip, src_prt, dst_ip, dst_prt, proto, action) AS line FROM ("
            + _FEED_SQL + " WHERE if_in <> 'lo' AND if_out <> 'lo' AND action <> 'ACCEPT') f) g"),
        "host_lookup": _hosts_with("SELECT p.id, " + _dotted("p.src_ip") + " AS src_ip, f.host FROM packets p LEFT JOIN fresh f ON f.ip = p.src_ip"),
        "host_dump_text": (f"WITH h AS ({_HOSTS_SQL}) SELECT {_dotted('ip')} AS ip, printf('%20s    %-50s', {_dotted('ip')}, host) AS line "
                           f"FROM h WHERE host <> {_dotted('ip')}"),
        "host_cache_clear": (f"WITH h AS ({_HOSTS_SQL}) SELECT s.step, CAST(CASE s.step WHEN 'written' THEN (SELECT count(*) FROM h) "
                             "WHEN 'pruned' THEN (SELECT count(*) FROM h WHERE coalesce(ttl >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 100 HOUR, true)) "
                             "ELSE 0 END AS BIGINT) AS n FROM (VALUES ('empty'), ('written'), ('pruned'), ('cleared')) s(step)"),
    }
