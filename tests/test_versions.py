"""Versioned tables under concurrent writers, file order, read-through naming, feed limits, follow state."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from loglines import write_lines
from packetlog.operators import feed as FD
from packetlog.operators.hosts import dump_hosts, lookup_hosts, resolve_hosts
from packetlog.operators.reports import denied_sources
from packetlog.plans import store, versions
from packetlog.plans.analysis import run_analysis
from packetlog.plans.ingest import packets_from_log
from packetlog.plans.naming import name_feed_through, name_reports_through, resolve_through
from packetlog.schema import DNS_SCHEMA
from packetlog.sources.syslog import read_syslog
from packetlog.streaming.follow import follow, read_feed

NOW = dt.datetime(2024, 1, 31)


def _log(i):
    return f"Jan  1 00:00:00 h k: IPT: DROP IN=eth0 SRC=10.0.0.{i % 256} DST=1.1.1.1 PROTO=TCP SPT={i} DPT=80"


def _at_once(*jobs):
    errors = []

    def run(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors, errors


def test_a_name_is_given_once(spark, tmpdir_path):
    path = tmpdir_path + "/with a blank/000.json"
    won = []
    _at_once(*[lambda k=k: won.append(versions.create_once(spark, path, f"text {k}")) for k in range(6)])
    assert sorted(won) == [False] * 5 + [True] and open(path).read().startswith("text ")
    for k in (1, 2):
        write_lines(tmpdir_path, f"draft{k}", ["x"])
    assert versions.rename_if_free(spark, f"file:{tmpdir_path}/draft1", f"file:{tmpdir_path}/target")
    assert not versions.rename_if_free(spark, f"file:{tmpdir_path}/draft2", f"file:{tmpdir_path}/target")


def test_parallel_imports_get_their_own_ids(spark, tmpdir_path):
    root = tmpdir_path + "/a table"
    for k in range(2):
        write_lines(f"{tmpdir_path}/in{k}", "log", [_log(i) for i in range(50 * (k + 1))])
    _at_once(*[lambda k=k: store.import_packets(spark, read_syslog(spark, f"{tmpdir_path}/in{k}"), root) for k in range(2)])
    ids = [r["id"] for r in store.read_packets(spark, root).orderBy("id").collect()]
    assert ids == list(range(1, 151))
    n = store.import_packets(spark, read_syslog(spark, f"{tmpdir_path}/in0"), root, clear=True).first()
    assert n["parsed"] == 50 and [r["id"] for r in store.read_packets(spark, root).orderBy("id").collect()] == list(range(1, 51))
    store.clear_packets(spark, root)
    assert store.read_packets(spark, root).count() == 0


def test_import_during_a_clear_is_numbered_again(spark, tmpdir_path, monkeypatch):
    root, table = tmpdir_path + "/t", None
    write_lines(tmpdir_path + "/in", "log", [_log(i) for i in range(10)])
    lines = read_syslog(spark, tmpdir_path + "/in")
    store.import_packets(spark, lines, root)
    write, cleared = versions.VersionedTable.write, []

    def interrupted(self, rows):
        folder = write(self, rows)
        if not cleared:
            cleared.append(True)
            store.clear_packets(spark, root)
        return folder

    monkeypatch.setattr(versions.VersionedTable, "write", interrupted)
    store.import_packets(spark, lines, root)
    assert [r["id"] for r in store.read_packets(spark, root).orderBy("id").collect()] == list(range(1, 11))
    assert len([d for d in os.listdir(root) if d.startswith("v=")]) <= 2


def test_concurrent_upserts_survive(spark, tmpdir_path):
    root = tmpdir_path + "/hosts"
    entry = lambda ip, host: spark.createDataFrame([(ip, host, NOW)], DNS_SCHEMA)
    store.write_host_table(spark, root, entry(1, "one"))
    _at_once(*[lambda k=k: store.upsert_host_table(spark, root, entry(k, f"host{k}")) for k in (1, 2, 3, 4)])
    assert {r["ip"]: r["host"] for r in store.read_host_table(spark, root).collect()} == {k: f"host{k}" for k in (1, 2, 3, 4)}
    old = store.host_table(spark, root)
    assert old.read(old.versions()[-2]).count() == 3  # the version before is still there


def test_clear_then_import_at_a_path_with_a_blank(spark, tmpdir_path):
    write_lines(tmpdir_path + "/in", "log", [_log(i) for i in range(3)])
    lines, path = read_syslog(spark, tmpdir_path + "/in"), tmpdir_path + "/a table"
    for clear in (False, True):
        store.import_log_to_path(spark, lines, path, clear=clear)
    assert spark.read.parquet(path).count() == 3


def test_order_of_files(spark, tmpdir_path):
    names = ["fw.log", "fw.log.1", "fw.log.2", "fw.log.10"]
    for k, name in enumerate(names):
        write_lines(tmpdir_path, name, [_log(k)])
    order = lambda paths: [r["src_prt"] for r in packets_from_log(read_syslog(spark, paths)).orderBy("id").collect()]
    assert order(tmpdir_path) == [3, 2, 1, 0]
    assert order([f"{tmpdir_path}/{n}" for n in ("fw.log.2", "fw.log.1", "fw.log")]) == [2, 1, 0]
    rows = packets_from_log(read_syslog(spark, [tmpdir_path + "/fw.log", tmpdir_path + "/fw.log", tmpdir_path])).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 7)) and [r["src_prt"] for r in rows] == [0, 0, 3, 2, 1, 0]
    dated = tmpdir_path + "/dated"
    for k, name in enumerate(["m.log", "m.log-20240103", "m.log-20240102.txt", "part-1", "part-0"]):
        write_lines(dated, name, [_log(k)])
    assert order(dated) == [1, 0, 2, 4, 3]


def test_names_are_read_through(spark, tmpdir_path):
    """Store, look up, look up in vain, prune: then resolve once only."""
    root, asked = tmpdir_path + "/hosts", spark.sparkContext.accumulator(0)

    def resolver(addresses):
        asked.add(len(addresses))
        return [None if a.endswith(".9") else f"host-{a.replace('.', '-')}.tld" for a in addresses]

    ip = lambda *last: spark.createDataFrame([(10 * 2 ** 24 + k,) for k in last], "ip long")
    assert resolve_through(spark, root, ip(1, 1, 9), resolver, NOW) == 2 and asked.value == 2
    assert resolve_through(spark, root, ip(1, 9), resolver, NOW) == 0 and asked.value == 2
    found = {r["ip"] % 256: r["host"] for r in lookup_hosts(store.read_host_table(spark, root), ip(1, 9, 42), now=NOW, max_age_hours=10).collect()}
    assert found == {1: "host-10-0-0-1.tld", 9: "10.0.0.9", 42: None}
    assert [r["ip"] for r in dump_hosts(store.read_host_table(spark, root)).collect()] == ["10.0.0.1"]
    assert resolve_through(spark, root, ip(1), resolver, NOW + dt.timedelta(hours=301)) == 1 and asked.value == 3
    store.prune_host_table(spark, root, 0, NOW + dt.timedelta(hours=302))
    assert store.read_host_table(spark, root).count() == 0

    write_lines(tmpdir_path + "/in", "log", [_log(i) for i in range(20)])
    logs = packets_from_log(read_syslog(spark, tmpdir_path + "/in"))
    before = asked.value
    named = name_reports_through({"d": denied_sources(logs, numeric_ips=True)}, spark, root, resolver, NOW)["d"]
    names = {r["src_ip"] % 256: r["src_ip_name"] for r in named.collect()}
    assert names[3] == "host-10-0-0-3.tld" and names[9] == "10.0.0.9" and asked.value == before + 11
    run_analysis(logs, host_root=root, resolver=resolver, now=NOW, show=False)
    assert asked.value == before + 11
    feed = name_feed_through(logs, spark, root, resolver, NOW).collect()
    assert len(feed) == 20 and all(r["src_ip_name"] == ("10.0.0.9" if r["src_ip"] % 256 == 9 else f"host-10-0-0-{r['src_ip'] % 256}.tld") for r in feed)


def test_a_resolver_that_raises_is_asked_again(spark):
    tries = spark.sparkContext.accumulator(0)

    def down(addresses):
        tries.add(1)
        raise OSError("no answer")

    missing = spark.createDataFrame([(1,), (2,)], "ip long")
    assert resolve_hosts(missing, down, NOW, retries=2).count() == 0 and tries.value == 3


def test_nth_packet_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(FD, "SORTED_LIMIT", 5)
    monkeypatch.setattr(FD, "ID_RANGES", 7)
    logs = spark.range(0, 3000, 3).select((F.col("id") + 11).alias("id"), *[F.lit(v).alias(c) for c, v in (("if_in", "eth0"), ("if_out", ""), ("proto", "TCP"), ("action", "DROP"))],
                                          *[F.lit(1).cast("long").alias(c) for c in ("src_ip", "src_prt", "dst_ip", "dst_prt")])
    for n in (1, 6, 7, 500, 999, 1000):
        assert FD.nth_id(logs, n) == 11 + 3 * (n - 1)
        feed = FD.scan_feed(logs, limit=n)
        assert sorted(r["packet_no"] for r in feed.collect()) == [11 + 3 * k for k in range(n)]
    assert FD.nth_id(logs, 1001) is None and FD.scan_feed(logs, limit=5000).count() == 1000
    plan = FD.scan_feed(logs, limit=600)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_follow_counts_on_and_takes_the_newest_names(spark, tmpdir_path):
    src, root = tmpdir_path + "/src", tmpdir_path + "/hosts"
    run = lambda: follow(spark, src, sink=tmpdir_path + "/sink", from_start=True, available_now=True, now=NOW,
                         cache=lambda s: store.read_host_table(s, root))[0].awaitTermination()
    for batch in range(4):
        write_lines(src, f"{batch}.log", [_log(batch)] * 5 + ["noise"])
        if batch == 2:
            store.write_host_table(spark, root, spark.createDataFrame([(10 * 2 ** 24 + k, f"name{k}", NOW) for k in (1, 2, 3)], DNS_SCHEMA))
        run()
    rows = read_feed(spark, tmpdir_path + "/sink").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 21)) and all(r["arrival"] is not None for r in rows)
    assert [r["src_ip_name"] for r in rows[::5]] == ["10.0.0.0", "10.0.0.1", "name2", "name3"]
    totals = {r["batch_id"]: r["total"] for r in spark.read.parquet(tmpdir_path + "/sink/_counts").collect()}
    assert totals == {0: 5, 1: 10, 2: 15, 3: 20}
