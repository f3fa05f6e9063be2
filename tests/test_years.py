"""Years by the order of the lines."""

import datetime as dt
import os

from loglines import write_lines

from packetlog.operators import years
from packetlog.plans.ingest import parse_log
from packetlog.sources import read_syslog


def line(t, text="IPT: DROP IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP SPT=1 DPT=2"):
    return f"{t:%b} {t.day:2d} {t:%H:%M:%S} fw kernel: {text}"


def times(spark, paths, modified, lines=None):
    for p in [paths] if isinstance(paths, str) else paths:
        os.utime(p, (modified.replace(tzinfo=dt.timezone.utc).timestamp(),) * 2)
    rows = parse_log(read_syslog(spark, paths), year="order")
    return [r["timestamp"] for r in rows.orderBy("id").collect()]


def test_three_years_over_several_splits(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(years, "RUN", 64)
    want = [dt.datetime(2023, 2, 1) + dt.timedelta(hours=7 * k) for k in range(3500)]  # to November 2025, over 29 February 2024
    path = write_lines(tmpdir_path, "fw.log", [line(t) for t in want])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "20000")
        assert read_syslog(spark, path).select("file_block_start").distinct().count() > 5
        assert times(spark, path, want[-1]) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_late_lines_rotations_and_lines_without_a_time(spark, tmpdir_path):
    first = [dt.datetime(2021, 11, 5), dt.datetime(2022, 1, 1, 0, 0, 1), dt.datetime(2021, 12, 31, 23, 59, 59), dt.datetime(2022, 1, 1, 0, 0, 2), dt.datetime(2022, 7, 4)]
    last = [dt.datetime(2022, 12, 30), dt.datetime(2023, 1, 2), dt.datetime(2024, 1, 1)]
    a = write_lines(tmpdir_path, "fw.log.1", [line(t) for t in first])
    b = write_lines(tmpdir_path, "fw.log", [line(last[0]), "IPT: x IPT: DROP IN=eth0", line(last[1]), line(dt.datetime(2023, 7, 1)), line(dt.datetime(2023, 10, 1)), line(last[2])])
    got = times(spark, [a, b], dt.datetime(2024, 1, 1))
    # Each listed file is a log of its own; the first one's last line is of July 2023 by its file's time.
    assert got[:5] == [t.replace(year=t.year + 1) for t in first]
    assert got[5:] == [last[0], None, last[1], dt.datetime(2023, 7, 1), dt.datetime(2023, 10, 1), last[2]]
    os.remove(write_lines(tmpdir_path, "none", []))
    rows = parse_log(read_syslog(spark, tmpdir_path), year="order").orderBy("id").collect()  # one entry: one log, oldest first
    assert [r["timestamp"] for r in rows][:5] == first and rows[-1]["timestamp"] == last[2]


def test_last_line_on_a_leap_day_and_empty_log(spark, tmpdir_path):
    path = write_lines(tmpdir_path, "fw.log", [line(dt.datetime(2023, 12, 1)), line(dt.datetime(2024, 2, 29))])
    assert times(spark, path, dt.datetime(2025, 6, 1)) == [dt.datetime(2023, 12, 1), dt.datetime(2024, 2, 29)]
    path = write_lines(tmpdir_path, "empty.log", ["nothing"])
    assert times(spark, path, dt.datetime(2025, 6, 1)) == []
