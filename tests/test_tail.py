"""Log files that grow: lines arrive once, through rotations and restarts."""

import os
import shutil

import pytest

from packetlog.operators import feed as FD
from packetlog.plans.ingest import packets_from_log
from packetlog.sources import read_syslog
from packetlog.streaming import tail
from packetlog.streaming.follow import follow_file, read_feed


def line(k):
    return f"Jan  1 00:00:{k % 60:02d} fw kernel: [{k}.0] IPT: {'DROP' if k % 3 else 'ACCEPT'} IN=eth0 OUT= SRC=10.0.{k // 256}.{k % 256} DST=1.1.1.1 PROTO=TCP SPT={k} DPT=80"


def append(path, first, stop, end="\n"):
    with open(path, "a") as fh:
        fh.write("\n".join(line(k) for k in range(first, stop)) + end)


def ports(rows):
    return [r["src_prt"] for r in sorted(rows, key=lambda r: r["packet_no"])]


@pytest.fixture()
def log(tmpdir_path):
    folder = os.path.join(tmpdir_path, "var")
    os.makedirs(folder)
    return os.path.join(folder, "fw.log")


@pytest.fixture()
def run(spark, tmpdir_path, log):
    """Reads what is there and stops; each call is a restart."""
    def go(**options):
        query, sink = follow_file(spark, log, sink=os.path.join(tmpdir_path, "sink"), available_now=True, **options)
        query.awaitTermination()
        if not os.path.exists(os.path.join(sink, "feed")):
            return []
        rows = read_feed(spark, sink).withColumnRenamed("id", "packet_no").collect()
        assert [r["packet_no"] for r in sorted(rows, key=lambda r: r["packet_no"])] == list(range(1, len(rows) + 1))
        return ports(rows)
    return go


def read(start, end, path, split_bytes=1 << 20):
    return [v for s in tail.splits([path], start, end, split_bytes) for b in tail.read_split(s) for v in b.column("value").to_pylist()]


def test_starts_at_the_end_and_goes_on_after_restarts(run, log):
    append(log, 0, 10)
    assert run() == []
    append(log, 10, 30)
    append(log, 30, 31, end="")                       # no LF yet
    assert run() == list(range(10, 30))
    assert run() == list(range(10, 30))
    append(log, 31, 31)                               # its LF
    append(log, 31, 50)
    assert run() == list(range(10, 50))


def test_lines_before_the_first_batch_are_not_lost_by_a_restart(run, log):
    append(log, 0, 5)
    assert run() == [] and run() == []
    append(log, 5, 9)
    assert run() == [5, 6, 7, 8]


def test_rotation_by_rename(run, log):
    append(log, 0, 10)
    assert run(from_start=True) == list(range(10))
    append(log, 10, 20)                               # unread when the file is renamed, twice
    os.rename(log, log + ".1")
    append(log, 20, 30)
    os.rename(log + ".1", log + ".2")
    os.rename(log, log + ".1")
    append(log, 30, 40)
    assert run() == list(range(40))
    os.remove(log + ".2")
    append(log, 40, 45)
    assert run() == list(range(45))


def test_rotation_by_copy(run, log):
    append(log, 0, 10)
    assert run(from_start=True) == list(range(10))
    append(log, 10, 20)
    shutil.copy(log, log + "-20240131")
    os.truncate(log, 0)
    append(log, 20, 30)
    assert run() == list(range(30))


def test_history_and_other_names_are_not_read(run, log):
    append(log + ".1", 0, 5)
    append(log + ".bak", 50, 55)
    append(log + ".2.gz", 60, 65)
    append(log, 5, 10)
    assert run(from_start=True) == list(range(5, 10))


def test_a_file_that_comes_later(run, log):
    assert run() == []
    append(log, 0, 4)
    assert run() == [0, 1, 2, 3]


def test_many_splits(run, log):
    append(log, 0, 500)
    assert run(from_start=True, split_bytes=1000) == list(range(500))


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_splits_give_each_line_once(log, size, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 64)
    text = ["first line", "", "b", "\r", "long " * 40, "ä€", "", "end"]
    with open(log, "w", newline="") as fh:
        fh.write("\n".join(text) + "\nunfinished" + "x" * 300)
    end = tail.offsets([log])
    assert read({}, end, log, size) == text
    known = next(iter(end[log]))
    part = {log: {known: len("first line\n\n")}}
    assert read(part, end, log, size) == text[2:]
    assert read(end, end, log, size) == []


def test_renamed_or_removed_between_planning_and_reading(log):
    append(log, 0, 5)
    todo = tail.splits([log], {}, tail.offsets([log]), 1 << 20)
    os.rename(log, log + ".1")
    append(log, 5, 9)
    assert [v for b in tail.read_split(todo[0]) for v in b.column("value").to_pylist()] == [line(k) for k in range(5)]
    os.remove(log + ".1")
    with pytest.raises(FileNotFoundError):
        list(tail.read_split(todo[0]))
    with pytest.raises(FileNotFoundError):
        tail.splits([log], {}, {log: {todo[0].known: todo[0].stop}}, 1 << 20)


def test_two_files_and_batch_read(spark, tmpdir_path, log):
    other = log.replace("fw.log", "gate.log")
    append(log, 0, 20)
    append(other, 100, 130)
    query, sink = follow_file(spark, [log, other], sink=os.path.join(tmpdir_path, "s"), available_now=True, from_start=True)
    query.awaitTermination()
    got = sorted(tuple(r) for r in FD.scan_feed(read_feed(spark, sink).withColumnRenamed("packet_no", "id")).collect())
    assert got == sorted(tuple(r) for r in FD.scan_feed(packets_from_log(read_syslog(spark, [log, other]))).collect())


def test_a_running_feed(spark, tmpdir_path, log):
    append(log, 0, 10)
    query, sink = follow_file(spark, log, sink=os.path.join(tmpdir_path, "s"))
    try:
        for first in (10, 20, 30):
            append(log, first, first + 10)
            query.processAllAvailable()
    finally:
        query.stop()
    rows = read_feed(spark, sink)
    assert ports(rows.withColumnRenamed("id", "packet_no").collect()) == list(range(10, 40))
    assert rows.select("batch_id").distinct().count() == 3
