"""Golden analysis: the 37 log lines implied by the sample report (FIXTURES §4)
through parse -> import -> six reports -> text."""

from loglines import write_lines

from packetlog.operators import reports as R
from packetlog.operators.render import report_text
from packetlog.plans.ingest import packets_from_log
from packetlog.sources.syslog import read_syslog

# Rows of the sample denied-traffic report (count, source, source
# port, destination, destination port, protocol, action).
SAMPLE_R1 = [
    (7, "142.255.211.121", 61630, "188.126.93.160", 80, "TCP", "INVALID"),
    (6, "213.136.38.8", 57049, "188.126.93.160", 80, "TCP", "INVALID"),
    (4, "46.45.161.187", 55844, "188.126.93.160", 445, "TCP", "CBLK"),
    (4, "194.63.142.101", 55078, "188.126.93.160", 110, "TCP", "CBLK"),
    (3, "60.223.238.19", 7175, "188.126.93.160", 25, "TCP", "DROP"),
    (3, "14.18.243.156", 27280, "188.126.93.160", 25, "TCP", "DROP"),
    (3, "60.223.231.147", 12060, "188.126.93.160", 25, "TCP", "DROP"),
    (2, "221.222.109.50", 41628, "188.126.93.160", 23, "TCP", "DROP"),
    (2, "92.253.83.177", 4056, "188.126.93.160", 23, "TCP", "DROP"),
    (1, "173.242.117.161", 5090, "188.126.93.160", 5087, "UDP", "DROP"),
    (1, "183.206.179.11", 28998, "188.126.93.160", 137, "UDP", "DROP"),
    (1, "173.242.117.161", 5090, "188.126.93.160", 5088, "UDP", "DROP"),
]
# The sample's other report rows.
SAMPLE_R3 = {(13, 80, "TCP", "INVALID"), (9, 25, "TCP", "DROP"), (4, 445, "TCP", "CBLK"), (4, 110, "TCP", "CBLK"),
             (4, 23, "TCP", "DROP"), (1, 5087, "UDP", "DROP"), (1, 5088, "UDP", "DROP"), (1, 137, "UDP", "DROP")}
SAMPLE_R4 = {(7, "142.255.211.121", 61630, "188.126.93.160", 80, "TCP"),
             (6, "213.136.38.8", 57049, "188.126.93.160", 80, "TCP")}
SAMPLE_R5 = {(13, "eth0", "DROP", "TCP"), (13, "eth0", "INVALID", "TCP"), (8, "eth0", "CBLK", "TCP"),
             (3, "eth0", "DROP", "UDP")}
SAMPLE_R6 = {(13, 80, "INVALID"), (9, 25, "DROP"), (4, 23, "DROP"), (4, 110, "CBLK"), (4, 445, "CBLK"),
             (1, 137, "DROP"), (1, 5087, "DROP"), (1, 5088, "DROP")}
# The sample's first text lines of the denied-traffic report.
SAMPLE_R1_TEXT = [
    "     7 142.255.211.121           61630 188.126.93.160               80 TCP    INVALID   ",
    "     3 60.223.238.19              7175 188.126.93.160               25 TCP    DROP      ",
    "     1 173.242.117.161            5090 188.126.93.160             5087 UDP    DROP      ",
]


def golden_lines():
    out = []
    n = 0
    for count, src, spt, dst, dpt, proto, action in SAMPLE_R1:
        for _ in range(count):
            n += 1
            out.append(f"May  4 06:35:{n % 60:02d} gate kernel: [{n}.0] IPT: {action} IN=eth0 OUT= "
                       f"MAC=02:00:bc:7e:5d:a0:00:13:5f:21:29:40:08:00 SRC={src} DST={dst} LEN=40 TOS=0x00 "
                       f"TTL=56 ID={n} PROTO={proto} SPT={spt} DPT={dpt} WINDOW=512 RES=0x00 SYN URGP=0 ")
    return out


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_golden_reports(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", golden_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    assert logs.count() == 37
    for use_rollup in (False, True):
        res = R.analysis(logs, limit=20, use_rollup=use_rollup)
        assert _rows(res["denied_sources"]) == set(SAMPLE_R1)
        assert res["icmp_traffic"].count() == 0
        assert _rows(res["denied_ports"]) == SAMPLE_R3
        assert _rows(res["invalid_sources"]) == SAMPLE_R4
        assert _rows(res["interface_stats"]) == SAMPLE_R5
        assert _rows(res["inbound_port_actions"]) == SAMPLE_R6
    text = {r["line"] for r in report_text(R.denied_sources(logs, 20), "denied_sources").collect()}
    for line in SAMPLE_R1_TEXT:
        assert line in text


def test_default_limit_cuts_by_tie_breakers(spark, tmpdir_path):
    write_lines(tmpdir_path, "syslog", golden_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    top = R.denied_sources(logs).collect()
    assert len(top) == 10
    # ties on count 1: numeric source address order decides
    assert [r["src_ip"] for r in top[-1:]] == ["173.242.117.161"]


def test_limit_is_checked(spark):
    import pytest
    for bad in (0, 1001, "5"):
        with pytest.raises(ValueError):
            R.check_limit(bad)


# Title and column header lines of the sample's first report.
SAMPLE_R1_HEAD = [
    "Showing denied traffic grouped by IP, destination port, action taken and protocol.",
    " Count Source IP                 SPort Dest IP                   DPort Proto  Action",
    "------ ------------------------- ----- ------------------------- ----- ------ ----------",
]


def test_printed_report_layout(spark, tmpdir_path, capsys):
    from packetlog.operators.render import print_report
    write_lines(tmpdir_path, "syslog", golden_lines())
    logs = packets_from_log(read_syslog(spark, tmpdir_path))
    out = print_report(R.denied_sources(logs, 20, with_rank=True), "denied_sources")
    assert out[0] == "" and out[1:4] == SAMPLE_R1_HEAD
    assert out[4] == SAMPLE_R1_TEXT[0]                      # rank order: the 7-packet row first
    assert len(out) == 4 + len(SAMPLE_R1)
    assert "Showing denied traffic" in capsys.readouterr().out
