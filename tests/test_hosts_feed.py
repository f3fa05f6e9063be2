"""Host table steps (the original's cache driver program), enrichment
strategies, feed filters and stream = batch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from loglines import write_lines
from packetlog.functions import ip_to_long
from packetlog.operators import feed as FD
from packetlog.operators import hosts as H
from packetlog.plans.ingest import packets_from_log
from packetlog.sources.syslog import read_syslog
from packetlog.streaming.follow import follow, read_feed

NOW = dt.datetime(2024, 1, 31)


def _cache(spark, rows):
    df = spark.createDataFrame(rows, "ip_text string, host string, ttl timestamp_ntz")
    return df.select(ip_to_long("ip_text").alias("ip"), "host", "ttl")


def test_cache_steps(spark):
    empty = _cache(spark, [])
    new = _cache(spark, [("10.0.0.1", "fake-hostname.tld", NOW)])
    cache = H.upsert_hosts(empty, new)
    fresh = H.fresh_hosts(cache, NOW + dt.timedelta(hours=1), 10).collect()
    assert [(r["ip"], r["host"]) for r in fresh] == [(167772161, "fake-hostname.tld")]
    missing = H.fresh_hosts(cache, NOW, 10).where(F.col("ip") == 168427521).count()
    assert missing == 0
    # Age 0 is accepted: entries written before now go, one written now stays.
    assert H.prune_hosts(cache, 0, NOW).count() == 1
    assert H.prune_hosts(cache, 0, NOW + dt.timedelta(seconds=1)).count() == 0
    with pytest.raises(ValueError):
        H.prune_hosts(cache, -1, NOW)


def test_upsert_replaces_and_is_idempotent(spark):
    cache = _cache(spark, [("1.1.1.1", "old.example", NOW - dt.timedelta(hours=5)),
                           ("2.2.2.2", "two.example", NOW)])
    new = _cache(spark, [("1.1.1.1", "new.example", NOW), ("3.3.3.3", "3.3.3.3", NOW)])
    once = H.upsert_hosts(cache, new)
    twice = H.upsert_hosts(once, new)
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    assert {(r[0], r[1]) for r in a} == {(16843009, "new.example"), (33686018, "two.example"), (50529027, "3.3.3.3")}
    # failed lookups are hidden from the dump, ordered by address
    assert [tuple(r) for r in H.dump_hosts(once).collect()] == [("1.1.1.1", "new.example"), ("2.2.2.2", "two.example")]


def test_prune_boundaries(spark):
    cache = _cache(spark, [("1.0.0.1", "a", NOW - dt.timedelta(hours=336)), ("1.0.0.2", "b", NOW - dt.timedelta(hours=337)),
                           ("1.0.0.3", "c", None)])
    kept = {r["host"] for r in H.prune_hosts(cache, 336, NOW).collect()}
    assert kept == {"a", "c"}


def test_resolver_and_negative_entries(spark):
    missing = spark.createDataFrame([(16843009,), (33686018,)], "ip long")
    out = H.resolve_hosts(missing, lambda ips: ["one.example" if i == "1.1.1.1" else None for i in ips], NOW)
    assert sorted((r["ip"], r["host"]) for r in out.collect()) == [(16843009, "one.example"), (33686018, "2.2.2.2")]


def _feed_lines():
    out = []
    for i in range(400):
        src = "7.7.7.7" if i % 3 == 0 else f"10.0.{i % 5}.{i % 7}"       # one hot source
        if i % 11 == 0:
            src = "fe80::1"                                            # NULL address
        iface = "lo" if i % 13 == 0 else "eth0"
        act = "ACCEPT" if i % 4 == 0 else "DROP"
        out.append(f"Jan  1 00:00:00 h k: IPT: {act} IN={iface} OUT= SRC={src} DST=10.0.0.{i % 3} "
                   f"PROTO=TCP SPT={1000 + i} DPT={23 if i % 2 else 80}")
        if i % 50 == 0:
            out.append("Jan  1 00:00:00 h k: noise")
    return out


def test_name_feed_broadcast_equals_skew_safe_shuffle(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", _feed_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    cache = _cache(spark, [("7.7.7.7", "hot.example.org", NOW), ("10.0.0.1", "a-very-long-host-name.some.example.org", NOW),
                           ("10.0.1.1", "stale.example", NOW - dt.timedelta(hours=301))])
    feed = FD.scan_feed(logs, numeric_ips=True)
    a = H.name_feed(feed, cache, now=NOW, row_key="packet_no")
    ra = sorted(tuple(r) for r in a.collect())
    assert len(ra) == 400
    for hot in (1, 3, 1000):        # cold shuffle path, both paths, hot path only
        b = H.name_feed(feed, cache, now=NOW, row_key="packet_no", max_broadcast=0, hot_keys=hot)
        assert sorted(tuple(r) for r in b.collect()) == ra
    names = {(r["src_ip"], r["src_ip_name"]) for r in a.collect()}
    assert (117901063, "hot.example.org") in names
    assert (167772417, "10.0.1.1") in names                           # stale entry not used
    assert any(n == "*ng-host-name.some.example.org" for _, n in {(r["dst_ip"], r["dst_ip_name"]) for r in a.collect()})


def test_feed_filters_and_counter_gaps(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", _feed_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    full = FD.scan_feed(logs).orderBy("packet_no").collect()
    assert [r["packet_no"] for r in full] == list(range(1, 401))
    filt = FD.scan_feed(logs, no_lo=True, no_accept=True).collect()
    assert all(r["action"] != "ACCEPT" and r["iface"] != "lo" for r in filt)
    assert len(filt) < 400 and max(r["packet_no"] for r in filt) <= 400
    first = FD.scan_feed(logs, limit=5).collect()
    assert [r["packet_no"] for r in first] == [1, 2, 3, 4, 5]
    bl = {r["src_ip"]: r["count"] for r in FD.block_list(logs, 80, "TCP").collect()}
    assert sum(bl.values()) == 200


def test_stream_equals_batch(spark, tmpdir_path):
    logdir = os.path.join(tmpdir_path, "in")
    write_lines(logdir, "a.log", _feed_lines()[:200])
    write_lines(logdir, "b.log", _feed_lines()[200:])
    batch = sorted(tuple(r) for r in FD.scan_feed(packets_from_log(read_syslog(spark, logdir))).collect())
    query, sink = follow(spark, logdir, sink=os.path.join(tmpdir_path, "sink"), from_start=True, available_now=True)
    query.awaitTermination()
    got = read_feed(spark, sink)
    assert "arrival" in got.columns
    stream = sorted(tuple(r) for r in FD.scan_feed(got.withColumnRenamed("packet_no", "id")).collect())
    assert stream == batch


def test_follow_starts_at_the_end(spark, tmpdir_path):
    logdir = os.path.join(tmpdir_path, "in")
    write_lines(logdir, "old.log", _feed_lines()[:10])
    query, sink = follow(spark, logdir, sink=os.path.join(tmpdir_path, "sink"), from_start=False,
                         available_now=True, start_time=dt.datetime.now() + dt.timedelta(days=1))
    query.awaitTermination()
    assert not os.path.exists(os.path.join(sink, "feed")) or read_feed(spark, sink).count() == 0


def test_lookup_hosts(spark):
    cache = _cache(spark, [("1.1.1.1", "one.example", NOW), ("2.2.2.2", "old.example", NOW - dt.timedelta(hours=400))])
    addrs = spark.createDataFrame([(16843009,), (33686018,), (50529027,)], "ip long")
    got = sorted(tuple(r) for r in H.lookup_hosts(cache, addrs, now=NOW).collect())
    assert got == [(16843009, "one.example"), (33686018, None), (50529027, None)]


def test_stream_counter_continues_across_batches(spark, tmpdir_path):
    import time as _time
    logdir = os.path.join(tmpdir_path, "in")
    lines = _feed_lines()
    now = _time.time()
    for k, part in enumerate([lines[:150], lines[150:300], lines[300:]]):
        path = write_lines(logdir, f"f{k}.log", part)
        os.utime(path, (now - 100 + k, now - 100 + k))      # arrival order f0, f1, f2
    batch = sorted(tuple(r) for r in FD.scan_feed(packets_from_log(read_syslog(spark, logdir))).collect())
    query, sink = follow(spark, logdir, sink=os.path.join(tmpdir_path, "sink"), from_start=True,
                         available_now=True, max_files_per_trigger=1)
    query.awaitTermination()
    got = read_feed(spark, sink)
    assert got.select("batch_id").distinct().count() == 3
    staging = os.path.join(sink, "_staging")
    assert not os.path.exists(staging) or os.listdir(staging) == []      # per-batch scratch removed
    stream = sorted(tuple(r) for r in FD.scan_feed(got.withColumnRenamed("packet_no", "id")).collect())
    assert stream == batch


def test_hot_source_is_spread_over_tasks(spark):
    """One source owns a third of the packets: in the shuffle path its rows
    are spread over many partitions instead of landing in one task."""
    n = 3000
    rows = [(i + 1, 117901063 if i % 3 == 0 else 167772160 + i, 16843009, "TCP", "DROP") for i in range(n)]
    feed = spark.createDataFrame(rows, "packet_no long, src_ip long, dst_ip long, proto string, action string")
    cache = _cache(spark, [("7.7.7.7", "hot.example.org", NOW), ("10.0.0.5", "five.example", NOW)])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")     # keep the shuffle layout visible
    try:
        named = H.name_feed(feed, cache, ip_cols=("src_ip",), now=NOW, row_key="packet_no",
                            max_broadcast=0, hot_keys=1)
        per_part = (named.where(F.col("src_ip") == 117901063).groupBy(F.spark_partition_id().alias("p"))
                    .count().collect())
        assert len(per_part) > 1
        assert max(r["count"] for r in per_part) < n // 3
        assert named.where(F.col("src_ip_name") == "hot.example.org").count() == n // 3
        assert named.where(F.col("src_ip_name") == "five.example").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_stream_with_host_names(spark, tmpdir_path):
    logdir = os.path.join(tmpdir_path, "in")
    write_lines(logdir, "a.log", _feed_lines()[:120])
    cache = _cache(spark, [("7.7.7.7", "hot.example.org", NOW)])
    query, sink = follow(spark, logdir, sink=os.path.join(tmpdir_path, "sink"), from_start=True,
                         available_now=True, cache=cache, now=NOW)
    query.awaitTermination()
    got = read_feed(spark, sink)
    names = {(r["src_ip"], r["src_ip_name"]) for r in got.collect()}
    assert (117901063, "hot.example.org") in names
    assert (167772417, "10.0.1.1") in names
