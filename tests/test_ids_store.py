"""File-order ids over several files and splits; table operations."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from loglines import write_lines
from packetlog.plans import store
from packetlog.plans.ingest import parse_log
from packetlog.sources.syslog import read_syslog


def _log(i):
    return f"Jan  1 00:00:00 h k: IPT: DROP IN=eth0 SRC=10.0.{i // 256 % 256}.{i % 256} DST=1.1.1.1 PROTO=TCP SPT={i} DPT=80"


def test_ids_follow_file_and_line_order_across_splits(spark, tmpdir_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # many splits per file
    try:
        n = 0
        for f in range(3):
            lines = []
            for i in range(700):
                lines.append(_log(n) if i % 7 else f"Jan  1 00:00:00 h k: noise {n}")
                n += 1
            write_lines(tmpdir_path, f"part-{f}.log", lines)
        lines = read_syslog(spark, tmpdir_path)
        assert lines.rdd.getNumPartitions() > 3
        rows = parse_log(lines).select("id", "src_prt").orderBy("id").collect()
        expected = [i for i in range(n) if (i % 700) % 7]
        assert [r["src_prt"] for r in rows] == expected
        assert [r["id"] for r in rows] == list(range(1, len(expected) + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gzip_rotation_is_read(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", [_log(1), _log(2)])
    with gzip.open(os.path.join(tmpdir_path, "syslog.1.gz"), "wt") as fh:
        fh.write(_log(3) + "\n")
    rows = parse_log(read_syslog(spark, tmpdir_path)).orderBy("id").collect()
    assert sorted(r["src_prt"] for r in rows) == [1, 2, 3]
    assert [r["id"] for r in rows] == [1, 2, 3]


def test_catalog_table_operations(spark, tmpdir_path):
    logdir = os.path.join(tmpdir_path, "in")
    write_lines(logdir, "syslog", [_log(i) for i in range(5)] + ["no marker here"])
    store.drop_table(spark, "logs_t")
    store.create_table(spark, "logs_t")
    with pytest.raises(ValueError):
        store.create_table(spark, "logs_t")
    listed = store.list_tables(spark).collect()
    assert "logs_t" in [r["name"] for r in listed]
    assert [r["number"] for r in listed] == list(range(1, len(listed) + 1))
    summary = store.import_log(spark, logdir, "logs_t").first().asDict()
    assert summary == {"lines_read": 6, "marker_lines": 5, "parsed": 5, "rejected": 0}
    store.import_log(spark, logdir, "logs_t")                      # append: counts double
    ids = [r["id"] for r in spark.table("logs_t").orderBy("id").collect()]
    assert ids == list(range(1, 11))
    write_lines(logdir, "syslog.bad", ["h XIPT: DROP"])
    rej = os.path.join(tmpdir_path, "rejects")
    s2 = store.import_log(spark, logdir, "logs_t", clear=True, rejects_path=rej)   # clear-then-import
    assert s2.first()["rejected"] == 1
    assert [r["id"] for r in spark.table("logs_t").orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert [(r["line"], r["reason"]) for r in spark.read.parquet(rej).collect()] == [("h XIPT: DROP", "no_marker_token")]
    store.clear_table(spark, "logs_t")
    assert spark.table("logs_t").count() == 0
    store.drop_table(spark, "logs_t")
    assert not spark.catalog.tableExists("logs_t")


def test_host_table_create(spark):
    store.drop_table(spark, "dns_t")
    store.create_host_table(spark, "dns_t")
    assert [f.name for f in spark.table("dns_t").schema.fields] == ["ip", "host", "ttl"]
    store.drop_table(spark, "dns_t")


def test_path_table_append_and_clear(spark, tmpdir_path):
    logdir = os.path.join(tmpdir_path, "in")
    write_lines(logdir, "syslog", [_log(i) for i in range(4)])
    path = os.path.join(tmpdir_path, "logs")
    lines = read_syslog(spark, logdir)
    store.import_log_to_path(spark, lines, path)
    store.import_log_to_path(spark, lines, path)
    df = spark.read.parquet(path)
    assert df.agg(F.count("*"), F.max("id")).first() == (8, 8)
    store.empty_table_at(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_staged_import_ids_across_splits(spark, tmpdir_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        logdir = os.path.join(tmpdir_path, "in")
        n = 0
        for f in range(3):
            lines = []
            for i in range(500):
                lines.append(_log(n) if i % 5 else f"Jan  1 00:00:00 h k: noise {n}")
                n += 1
            write_lines(logdir, f"part-{f}.log", lines)
        path = os.path.join(tmpdir_path, "logs")
        store.import_log_to_path(spark, read_syslog(spark, logdir), path)
        rows = spark.read.parquet(path).select("id", "src_prt").orderBy("id").collect()
        expected = [i for i in range(n) if (i % 500) % 5]
        assert [r["src_prt"] for r in rows] == expected
        assert [r["id"] for r in rows] == list(range(1, len(expected) + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_path_import_summary_with_rejects(spark, tmpdir_path):
    logdir = os.path.join(tmpdir_path, "in")
    write_lines(logdir, "syslog", [_log(i) for i in range(6)] + ["x XIPT: DROP", "noise", "h IPT: "])
    rej = os.path.join(tmpdir_path, "rejects")
    s = store.import_log_to_path(spark, read_syslog(spark, logdir), os.path.join(tmpdir_path, "t"), rejects_path=rej)
    assert s.first().asDict() == {"lines_read": 9, "marker_lines": 8, "parsed": 6, "rejected": 2}
    got = sorted(tuple(r) for r in spark.read.parquet(rej).collect())
    assert got == [(7, "x XIPT: DROP", "no_marker_token"), (8, "h IPT: ", "no_action")]


def test_split_offsets_in_slices(spark, tmpdir_path, monkeypatch):
    """Many splits: the running sum over splits runs in ordered slices and
    gives the same ids as the single window."""
    from packetlog.operators import ids
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        logdir = os.path.join(tmpdir_path, "in")
        n = 0
        for f in range(4):
            write_lines(logdir, f"part-{f}.log", [_log(n + i) for i in range(300)])
            n += 300
        lines = read_syslog(spark, logdir)
        monkeypatch.setattr(ids, "SINGLE_TASK_SPLITS", 5)
        rows = parse_log(lines).select("id", "src_prt").orderBy("id").collect()
        assert [r["src_prt"] for r in rows] == list(range(n))
        assert [r["id"] for r in rows] == list(range(1, n + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
