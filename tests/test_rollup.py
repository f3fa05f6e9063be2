"""Roll-ups stored with the packets of each import."""

import threading

import pytest
from loglines import write_lines

from packetlog.operators import reports as R
from packetlog.plans import store
from packetlog.sources import read_syslog


@pytest.fixture()
def load(spark, tmpdir_path):
    def run(first, n, **options):
        lines = [f"Jan  1 00:00:00 fw IPT: {'DROP' if k % 3 else 'ACCEPT'} IN=eth{k % 2} SRC=1.2.3.{k % 5} DST=5.6.7.{k % 7} PROTO={'TCP' if k % 4 else 'ICMP'} SPT={k} DPT={k % 2}"
                 for k in range(first, first + n)]
        return store.import_packets(spark, read_syslog(spark, write_lines(tmpdir_path, f"{first}.log", lines)), f"{tmpdir_path}/logs", **options)
    return run


def equal(spark, root):
    direct = R.analysis(store.read_packets(spark, root), 50, use_rollup=False, with_rank=True)
    stored = R.analysis_from_rollup(store.read_rollup(spark, root), 50, with_rank=True)
    return all(direct[n].collect() == stored[n].collect() for n in R.REPORT_ORDER)


def test_reports_read_no_packets_and_imports_without_a_rollup(spark, tmpdir_path, load, monkeypatch):
    root = f"{tmpdir_path}/logs"
    assert store.read_rollup(spark, root).count() == 0
    monkeypatch.setattr(store, "MERGE_ROLLUPS", 2)
    load(0, 40, rollup=True)
    load(100, 40, rollup=True)
    state = store.packet_table(spark, root).state()
    assert len(state["derived"]) == 1 and len(state["covers"]) == len(state["folders"]) == 2
    assert all("/d=" in f for f in store.read_rollup(spark, root).inputFiles()) and equal(spark, root)
    load(200, 30)
    assert any("/v=" in f for f in store.read_rollup(spark, root).inputFiles()) and equal(spark, root)
    load(300, 20, clear=True)
    assert equal(spark, root)
    load(400, 20, clear=True, rollup=True)
    assert all("/d=" in f for f in store.read_rollup(spark, root).inputFiles()) and equal(spark, root)
    store.clear_packets(spark, root)
    assert store.read_rollup(spark, root).count() == 0


def test_imports_at_the_same_time(spark, tmpdir_path, load):
    threads = [threading.Thread(target=load, args=(k * 50, 20), kwargs={"rollup": True}) for k in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert store.read_packets(spark, f"{tmpdir_path}/logs").count() == 60 and equal(spark, f"{tmpdir_path}/logs")


@pytest.fixture()
def load_spread(spark, tmpdir_path):
    """Packets of ``groups`` different keys; stored if the sketch says that it pays."""
    def run(name, n, groups, **options):
        lines = [f"Jan  1 00:00:00 fw IPT: DROP IN=eth0 SRC=10.{k % groups // 65536}.{k % groups // 256 % 256}.{k % groups % 256} DST=5.6.7.8 PROTO=TCP SPT={k} DPT=80"
                 for k in range(n)]
        log = read_syslog(spark, write_lines(tmpdir_path, name, lines))
        return store.import_packets(spark, log, f"{tmpdir_path}/logs", rollup="auto", **options)
    return run


def test_a_sketch_decides_whether_a_rollup_is_stored(spark, tmpdir_path, load_spread):
    root = f"{tmpdir_path}/logs"
    table = store.packet_table(spark, root, rollup="auto")

    def same():
        direct = R.analysis(store.read_packets(spark, root), 50, use_rollup=False, with_rank=True)
        stored = store.stored_analysis(spark, root, 50, with_rank=True)
        return all(direct[n].collect() == stored[n].collect() for n in R.REPORT_ORDER)

    load_spread("wide", 3000, 3000)
    state = table.state()
    assert not state.get("derived") and table.facts()["packets"] == 3000 and same()
    assert abs(R.rollup_groups(spark, table.facts()) - 3000) < 600
    load_spread("narrow", 5000, 100)                # the same keys as a part of the first
    state = table.state()
    assert len(state["derived"]) == 1 and len(state["folders"]) == 2 and same()
    assert table.facts()["packets"] == 8000 and abs(R.rollup_groups(spark, table.facts()) - 3000) < 600
    assert R.rollup_pays(spark, table.facts())      # both together: 8000 packets of about 3000 keys
    load_spread("new", 1000, 10, clear=True)
    assert table.facts()["packets"] == 1000 and set(table.state()["covers"]) == set(table.state()["folders"]) and same()
    store.clear_packets(spark, root)
    assert table.facts() is None and same()
    load_spread("more", 50, 5)
    store.import_packets(spark, read_syslog(spark, f"{tmpdir_path}/new"), root)
    assert table.facts() is None and same()         # an import without facts


def test_choice_on_any_table(spark):
    rows = [(k, "eth0", "", k % 7, 80, "TCP", "DROP" if k % 2 else "ACCEPT", 1, 2) for k in range(500)]
    few = spark.createDataFrame(rows, "id long, if_in string, if_out string, src_ip long, dst_prt long, proto string, action string, src_prt long, dst_ip long")
    many = few.selectExpr("id", "if_in", "if_out", "id AS src_ip", "dst_prt", "proto", "'DROP' AS action", "src_prt", "dst_ip")
    for logs, pays in ((few, True), (many, False), (few.limit(0), True)):
        facts = logs.agg(*R.rollup_facts()).first().asDict()
        assert R.rollup_pays(spark, facts) is pays
        a, b = R.analysis(logs, 20, "auto"), R.analysis(logs, 20, False)
        assert all(a[n].collect() == b[n].collect() for n in R.REPORT_ORDER)
