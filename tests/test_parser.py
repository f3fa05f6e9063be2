"""Parser contract, one line per case."""

from loglines import write_lines

from packetlog.plans.ingest import parse_log, import_summary
from packetlog.operators.parse import packets, rejects
from packetlog.sources.syslog import read_syslog

EXAMPLE = ("May  4 06:35:08 gate kernel: [1749207.946614] IPT: CBLK IN=eth0 OUT= "
           "MAC=02:00:bc:7e:5d:a0:00:13:5f:21:29:40:08:00 SRC=46.45.161.187 DST=188.126.93.160 LEN=40 "
           "TOS=0x00 PREC=0x00 TTL=56 ID=10028 PROTO=TCP SPT=55844 DPT=445 WINDOW=512 RES=0x00 SYN URGP=0 ")

H = "May  4 06:35:08 fw kernel: [1.0]"
CASES = [
    # (name, line, expected dict or None for reject / skip)
    ("example", EXAMPLE, dict(action="CBLK", if_in="eth0", if_out="", src_ip=774742459, dst_ip=3162398112,
                              proto="TCP", src_prt=55844, dst_prt=445,
                              mac="02:00:bc:7e:5d:a0:00:13:5f:21:29:40:08:00")),
    ("many_spaces", f"{H}   IPT:    DROP   IN=eth1    SRC=1.2.3.4   DST=5.6.7.8  PROTO=UDP  SPT=1 DPT=2",
     dict(action="DROP", if_in="eth1", src_ip=16909060, dst_ip=84281096, proto="UDP", src_prt=1, dst_prt=2)),
    ("no_signal_word", f"{H} IPT: IN=eth0 OUT= SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP",
     dict(action="IN=eth0", if_in="", if_out="")),
    ("action_override", f"{H} IPT: ACCEPT IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP ACTION=DROP",
     dict(action="DROP")),
    ("action_override_empty", f"{H} IPT: ACCEPT IN=eth0 ACTION= PROTO=TCP", dict(action="")),
    ("inner_packet", f"{H} IPT: DROP IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=ICMP TYPE=3 CODE=3 "
                     "[SRC=5.6.7.8 DST=9.9.9.9 LEN=28 PROTO=UDP SPT=53 DPT=33434 LEN=8 ]",
     dict(src_ip=16909060, dst_ip=151587081, proto="UDP", src_prt=53, dst_prt=33434)),
    ("missing_ports", f"{H} IPT: DROP IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=ICMP TYPE=8",
     dict(src_prt=0, dst_prt=0, proto="ICMP")),
    ("ipv6", f"{H} IPT: DROP IN=eth0 SRC=fe80::1 DST=ff02::1 PROTO=UDP SPT=5 DPT=6",
     dict(src_ip=None, dst_ip=None, src_prt=5)),
    ("quote", f"{H} IPT: DR'OP IN=et'h0 SRC=1.2.3.4", dict(action="DR'OP", if_in="et'h0")),
    ("tab_is_not_a_separator", f"{H} IPT: DROP IN=eth0\tOUT=eth1 SRC=1.2.3.4",
     dict(if_in="eth0\tOUT=eth1", if_out="")),
    ("bad_port", f"{H} IPT: DROP SPT=12ab DPT=x PROTO=TCP", dict(src_prt=12, dst_prt=0)),
    ("marker_inside_value", f"{H} IPT: DROP IN=eth0 OUT=IPT: SRC=1.2.3.4", dict(action="DROP", if_out="IPT:")),
    ("first_token_marker_then_real", "IPT: x IPT: REJECT IN=eth9", dict(action="REJECT", if_in="eth9")),
    ("leading_spaces", "   host IPT: DROP IN=eth3", dict(action="DROP", if_in="eth3")),
    ("no_marker", f"{H} usb 1-1: reset", "skip"),
    ("marker_first_token", "IPT: DROP IN=eth0 SRC=1.2.3.4", "reject"),
    ("glued_marker", f"{H} XIPT: DROP IN=eth0", "reject"),
    ("nothing_after_marker", f"{H} IPT: ", "reject"),
    ("marker_at_end", f"{H} IPT:", "skip"),
]


def test_parser_cases(spark, tmpdir_path):
    write_lines(tmpdir_path, "a.log", [c[1] for c in CASES])
    lines = read_syslog(spark, tmpdir_path)
    parsed = parse_log(lines, keep_lines=True).orderBy("id").collect()
    by_value = {r["value"]: r for r in parsed}
    for name, line, expect in CASES:
        if expect == "skip":
            assert line not in by_value, name
            continue
        row = by_value[line]
        if expect == "reject":
            assert not row["ok"], name
            continue
        assert row["ok"], name
        for k, v in expect.items():
            assert row[k] == v, (name, k, row[k], v)


def test_ids_count_marker_lines_only(spark, tmpdir_path):
    write_lines(tmpdir_path, "a.log", [c[1] for c in CASES])
    parsed = parse_log(read_syslog(spark, tmpdir_path), keep_lines=True).orderBy("id").collect()
    marker = [c[1] for c in CASES if "IPT: " in c[1]]
    assert [r["value"] for r in parsed] == marker
    assert [r["id"] for r in parsed] == list(range(1, len(marker) + 1))


def test_rejects_and_summary(spark, tmpdir_path):
    write_lines(tmpdir_path, "a.log", [c[1] for c in CASES])
    lines = read_syslog(spark, tmpdir_path)
    rej = {r["line"]: r["reason"] for r in rejects(parse_log(lines)).collect()}
    assert rej == {
        "IPT: DROP IN=eth0 SRC=1.2.3.4": "no_marker_token",
        f"{H} XIPT: DROP IN=eth0": "no_marker_token",
        f"{H} IPT: ": "no_action",
    }
    s = import_summary(lines).first().asDict()
    n_marker = sum("IPT: " in c[1] for c in CASES)
    assert s == {"lines_read": len(CASES), "marker_lines": n_marker, "parsed": n_marker - 3, "rejected": 3}
    assert packets(parse_log(lines)).count() == n_marker - 3


def test_event_time(spark, tmpdir_path):
    write_lines(tmpdir_path, "a.log", [EXAMPLE, "Dec 31 23:59:59 h k: IPT: DROP", "Feb 30 01:02:03 h k: IPT: DROP"])
    rows = parse_log(read_syslog(spark, tmpdir_path), year=2024).orderBy("id").collect()
    import datetime as dt
    assert rows[0]["timestamp"] == dt.datetime(2024, 5, 4, 6, 35, 8)
    assert rows[1]["timestamp"] == dt.datetime(2024, 12, 31, 23, 59, 59)
    assert rows[2]["timestamp"] is None


def test_event_time_header_forms(spark):
    import datetime as dt
    from packetlog.functions import syslog_event_time
    rows = [("May  4 06:35:08 host k:",), ("May 14 06:35:08 host",), ("May 4 06:35:08",), ("Foo  4 06:35:08 x",),
            ("May  4 06:35 x",), ("May  4 06:35:081",), ("May 32 06:35:08 x",), ("",)]
    df = spark.createDataFrame(rows, "v string")
    got = [r[0] for r in df.select(syslog_event_time("v", 2024)).collect()]
    assert got == [dt.datetime(2024, 5, 4, 6, 35, 8), dt.datetime(2024, 5, 14, 6, 35, 8), dt.datetime(2024, 5, 4, 6, 35, 8),
                   None, None, None, None, None]


def test_year_from_file_time_with_wrap(spark, tmpdir_path):
    import datetime as dt
    import os
    import time
    path = write_lines(tmpdir_path, "a.log", ["Dec 31 23:59:00 h k: IPT: DROP IN=eth0", "Jan  2 00:00:01 h k: IPT: DROP IN=eth0"])
    mtime = time.mktime(dt.datetime(2025, 1, 5, 12, 0, 0).timetuple())
    os.utime(path, (mtime, mtime))
    rows = parse_log(read_syslog(spark, tmpdir_path), year="auto").orderBy("id").collect()
    assert [r["timestamp"] for r in rows] == [dt.datetime(2024, 12, 31, 23, 59, 0), dt.datetime(2025, 1, 2, 0, 0, 1)]
    from packetlog.plans.store import import_log_to_path
    out = os.path.join(tmpdir_path, "t")
    import_log_to_path(spark, read_syslog(spark, tmpdir_path), out, year="auto")
    got = [r["timestamp"] for r in spark.read.parquet(out).orderBy("id").collect()]
    assert got == [dt.datetime(2024, 12, 31, 23, 59, 0), dt.datetime(2025, 1, 2, 0, 0, 1)]
