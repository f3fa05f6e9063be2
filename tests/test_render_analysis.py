import datetime as dt
import os

from loglines import write_lines
from test_golden import golden_lines

from packetlog.functions import ip_to_long
from packetlog.operators import feed as FD
from packetlog.operators.render import FEED_HEADER_NO_COUNT, feed_text, print_feed, with_headers
from packetlog.plans import store
from packetlog.plans.analysis import run_analysis
from packetlog.plans.ingest import packets_from_log
from packetlog.sources.syslog import read_syslog


def test_with_headers_every_20():
    out = with_headers([str(i) for i in range(45)], ["H1", "H2"])
    assert out.count("H1") == 3
    assert out[:4] == ["", "H1", "H2", "0"]
    assert out[out.index("19") + 1:out.index("19") + 4] == ["", "H1", "H2"]


def test_feed_text_layout(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", golden_lines()[:3])
    f = FD.scan_feed(packets_from_log(read_syslog(spark, tmpdir_path)))
    lines = [r["line"] for r in feed_text(f).orderBy("packet_no").collect()]
    assert lines[0] == ("%8d %-8s %-30s %5d %-30s %5d %-10s %-10s"
                        % (1, "eth0", "142.255.211.121", 61630, "188.126.93.160", 80, "TCP", "INVALID"))
    no_count = [r["line"] for r in feed_text(f, counter=False).collect()]
    assert all(not line.startswith(" ") for line in no_count)
    printed = print_feed(f, max_lines=3, counter=False)
    assert printed[1] == FEED_HEADER_NO_COUNT[0][9:]


def test_run_analysis_with_hosts(spark, tmpdir_path, capsys):
    write_lines(tmpdir_path, "syslog", golden_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    now = dt.datetime(2024, 1, 31)
    hosts = spark.createDataFrame([("142.255.211.121", "scanner.bad.example.net", now)],
                                  "t string, host string, ttl timestamp_ntz").select(
        ip_to_long("t").alias("ip"), "host", "ttl")
    res = run_analysis(logs, limit=20, hosts=hosts, now=now)
    top = res["denied_sources"].orderBy("rank").first()
    assert (top["src_ip"], top["src_ip_name"], top["dst_ip_name"]) == ("142.255.211.121", "scanner.bad.example.net",
                                                                        "188.126.93.160")
    out = capsys.readouterr().out
    assert "Most denied ports" in out and "scanner.bad.example.net" in out


def test_host_snapshots(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "dns")
    assert store.read_host_table(spark, root).count() == 0
    now = dt.datetime(2024, 1, 31)
    first = spark.createDataFrame([(1, "a", now)], "ip long, host string, ttl timestamp_ntz")
    store.write_host_table(spark, root, first)
    current = store.read_host_table(spark, root)
    from packetlog.operators.hosts import upsert_hosts
    store.write_host_table(spark, root, upsert_hosts(current, spark.createDataFrame([(2, "b", now)], first.schema)))
    assert sorted(r["ip"] for r in store.read_host_table(spark, root).collect()) == [1, 2]
    store.clear_host_table(spark, root)
    assert store.read_host_table(spark, root).count() == 0


def test_custom_sql_over_registered_views(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", golden_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    store.register_views(spark, logs, logs_view="logs_custom")
    got = spark.sql("SELECT action, count(*) AS n FROM logs_custom GROUP BY action ORDER BY action").collect()
    assert [(r["action"], r["n"]) for r in got] == [("CBLK", 8), ("DROP", 16), ("INVALID", 13)]
