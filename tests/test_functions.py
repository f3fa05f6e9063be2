import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetlog.functions import ip_to_long, long_to_ip, port_number, shown_interface, trim_host
from packetlog.functions.eventtime import is_fresh, survives_prune


def test_ip_round_trip_and_invalid(spark):
    rows = [("0.0.0.0",), ("255.255.255.255",), ("203.0.5.220",), ("256.1.1.1",), ("1.2.3",),
            ("::1",), ("",), (None,), ("01.002.3.4",)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select("t", ip_to_long("t").alias("n"), long_to_ip(ip_to_long("t")).alias("b")).collect()]
    assert got == [("0.0.0.0", 0, "0.0.0.0"), ("255.255.255.255", 4294967295, "255.255.255.255"),
                   ("203.0.5.220", 3405776348, "203.0.5.220"), ("256.1.1.1", None, None), ("1.2.3", None, None),
                   ("::1", None, None), ("", None, None), (None, None, None), ("01.002.3.4", 16909060, "1.2.3.4")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50))
def test_long_to_ip_inverse(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n long")
    back = [r[0] for r in df.select(ip_to_long(long_to_ip("n"))).collect()]
    assert back == values


def test_port_number(spark):
    df = spark.createDataFrame([("445",), ("",), ("12ab",), ("x",), (" 7",), ("+9",), ("99999999999",)], "p string")
    assert [r[0] for r in df.select(port_number("p")).collect()] == [445, 0, 12, 0, 7, 9, 4294967295]


def test_trim_host_keeps_tail(spark):
    host = "c-83-233-6f44.cust.bredbandsbolaget.se"
    df = spark.createDataFrame([(host,), ("short.example",)], "h string")
    got = [r[0] for r in df.select(trim_host("h", 30)).collect()]
    assert got == ["*6f44.cust.bredbandsbolaget.se", "short.example"]
    assert all(len(g) <= 30 for g in got)


def test_shown_interface(spark):
    df = spark.createDataFrame([("eth0", ""), ("", "eth1"), ("", "")], "if_in string, if_out string")
    assert [r[0] for r in df.select(shown_interface()).collect()] == ["eth0", "eth1", ""]


def test_age_tests_are_strict(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [(now - dt.timedelta(hours=300),), (now - dt.timedelta(hours=299),), (now - dt.timedelta(hours=336),),
            (now - dt.timedelta(hours=337),), (None,)]
    df = spark.createDataFrame(rows, "ttl timestamp_ntz")
    got = [tuple(r) for r in df.select(is_fresh("ttl", now, 300), survives_prune("ttl", now, 336)).collect()]
    assert got == [(False, True), (True, True), (False, True), (False, False), (None, True)]
