"""Stores that survive a failed write, event years, line ends and the full feed."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from loglines import write_lines
from packetlog.functions.eventtime import event_time_before, ntz_literal
from packetlog.operators import feed as FD
from packetlog.operators.render import FEED_HEADER, feed_lines, print_feed, write_feed
from packetlog.plans import store
from packetlog.plans.ingest import packets_from_log
from packetlog.schema import DNS_SCHEMA
from packetlog.sources.syslog import read_syslog
from test_golden import golden_lines


def _boom(spark, schema):
    fail = F.udf(lambda x: 1 // 0, "long")
    return spark.range(3).select(*[fail("id").cast(f.dataType).alias(f.name) if f.name == "ip" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def test_host_table_survives_a_failed_write(spark, tmpdir_path):
    root = tmpdir_path + "/hosts"
    one = spark.createDataFrame([(1, "a", None)], DNS_SCHEMA)
    store.write_host_table(spark, root, one)
    with pytest.raises(Exception):
        store.write_host_table(spark, root, _boom(spark, DNS_SCHEMA))
    assert store.read_host_table(spark, root).count() == 1
    store.write_host_table(spark, root, one.union(one))
    store.write_host_table(spark, root, one.union(one).union(one))
    assert store.read_host_table(spark, root).count() == 3
    assert len([d for d in os.listdir(root) if d.startswith("v=")]) == store.KEPT_SNAPSHOTS


def test_clear_then_import_keeps_the_old_rows_on_failure(spark, tmpdir_path, monkeypatch):
    write_lines(tmpdir_path + "/log", "a", golden_lines())
    lines, path = read_syslog(spark, tmpdir_path + "/log"), tmpdir_path + "/t"
    store.import_log_to_path(spark, lines, path)
    n = spark.read.parquet(path).count()
    number = store.number_staged

    def broken(*args, **kw):
        return number(*args, **kw).withColumn("id", F.udf(lambda x: 1 // 0, "long")("id"))

    monkeypatch.setattr(store, "number_staged", broken)
    with pytest.raises(Exception):
        store.import_log_to_path(spark, lines, path, clear=True)
    assert spark.read.parquet(path).count() == n
    monkeypatch.undo()
    store.import_log_to_path(spark, lines, path, clear=True)
    assert spark.read.parquet(path).count() == n


def test_clear_a_table_with_a_path(spark, tmpdir_path):
    write_lines(tmpdir_path + "/log", "a", golden_lines())
    store.create_table(spark, "cleared_at_path", path=tmpdir_path + "/t")
    store.import_log(spark, tmpdir_path + "/log", "cleared_at_path")
    n = spark.table("cleared_at_path").count()
    store.import_log(spark, tmpdir_path + "/log", "cleared_at_path", clear=True)
    assert spark.table("cleared_at_path").count() == n > 0
    store.clear_table(spark, "cleared_at_path")
    assert spark.table("cleared_at_path").count() == 0
    store.drop_table(spark, "cleared_at_path")


def test_event_year(spark):
    cases = [("Jun 10 14:00:00 x", "2024-06-10 12:00:00", "2024-06-10 14:00:00"),  # the log host is ahead of UTC
             ("Dec 31 23:00:00 x", "2025-01-01 01:00:00", "2024-12-31 23:00:00"),
             ("Feb 29 10:00:00 x", "2025-01-05 00:00:00", "2024-02-29 10:00:00"),
             ("Feb 30 10:00:00 x", "2025-01-05 00:00:00", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "line string, m string")
    got = df.select(event_time_before("line", F.col("m").cast("timestamp_ntz")).cast("string").alias("t")).collect()
    assert [r.t for r in got] == [c for _, _, c in cases]


def test_aware_times_are_utc(spark):
    aware = dt.datetime(2024, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert spark.range(1).select(ntz_literal(aware).cast("string")).first()[0] == "2024-01-01 00:00:00"


def test_lines_end_at_lf(spark, tmpdir_path):
    with open(tmpdir_path + "/log", "wb") as fh:
        fh.write(b"one\rstill one\r\ntwo\n")
    assert [r.value for r in read_syslog(spark, tmpdir_path + "/log").collect()] == ["one\rstill one", "two"]


def test_whole_feed_is_printed_and_written(spark, tmpdir_path, capsys):
    line = golden_lines()[0]
    write_lines(tmpdir_path + "/log", "a", [line] * 1500)
    feed = FD.scan_feed(packets_from_log(read_syslog(spark, tmpdir_path + "/log")))
    rows = feed_lines(feed).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, 1501)) == [r.packet_no for r in rows]
    assert [r.line_no for r in rows if "\n" in r.line] == list(range(1, 1501, 20))
    write_feed(feed, tmpdir_path + "/text")
    written = sorted(f for f in os.listdir(tmpdir_path + "/text") if f.startswith("part"))
    text = "".join(open(f"{tmpdir_path}/text/{f}").read() for f in written)
    print_feed(feed)
    assert text == capsys.readouterr().out and text.count(FEED_HEADER[0][9:]) == 75 and len(text.splitlines()) == 1500 + 75 * 3
