"""Test inputs derived by Spark from the driver's tables.

The driver ships no packet log, so one syslog line is rendered per ``events``
row (layout in FIXTURES.md §5) and written as text files under the shared
scratch folder; the parser then reads them back like any log. The host table
is derived from ``customer``. An independent SQL engine computes the expected
packet columns straight from ``events`` by integer formulas, without parsing.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eventtime import MONTHS, ntz_literal
from ..functions.ipaddr import long_to_ip
from ..session import jit_sized_codegen, path_exists, scratch_path

# Bump when the rendered layout or the import changes: cached copies are keyed by it.
FIXTURE_VERSION = "5"

# Fixed values of the fixture (FIXTURES.md §5).
FIXTURE_MAC = "02:00:bc:7e:5d:a0:00:13:5f:21:29:40:08:00"
FIXTURE_PORTS = [80, 25, 445, 110, 23, 5087, 137, 53]
FIXTURE_YEAR = 2024
FIXTURE_NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)
INNER_PACKET = "[SRC=1.2.3.4 DST=9.9.9.9 LEN=28 PROTO=UDP SPT=53 DPT=33434 LEN=8 ] "


def _code_digest() -> str:
    """Digest of the library source: derived copies are rebuilt whenever the
    renderer, parser or import code changes."""
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1(FIXTURE_VERSION.encode())
    shaping = ["sources", "functions", "operators/parse.py", "operators/ids.py", "plans/ingest.py",
               "plans/store.py", "plans/testdata.py", "session.py", "schema.py"]
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            rel = os.path.relpath(os.path.join(d, f), root)
            if f.endswith(".py") and any(rel == p or rel.startswith(p + "/") for p in shaping):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(rel.encode() + fh.read())
    return h.hexdigest()[:10]


_CODE = _code_digest()


def _key(sf_dir: str) -> str:
    return _CODE + "-" + hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:12]


def render_syslog(events: DataFrame) -> DataFrame:
    """One syslog line per event: ``event_id``, ``value``."""
    e = F.col("event_id")
    u = F.col("user_id")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    ts = F.col("ts")
    header = F.format_string("%s %2d %02d:%02d:%02d",
                             F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts)),
                             F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))
    action = (F.when(F.col("event_type") == "error", "INVALID")
               .when(F.col("event_type") == "purchase", "DROP")
               .when(F.col("event_type") == "signup", "CBLK")
               .otherwise("ACCEPT"))
    if_in = (F.when(e % 17 == 0, "lo").when(e % 5 == 0, "")
              .otherwise(F.concat(F.lit("eth"), (e % 2).cast("string"))))
    if_out = F.when(e % 19 == 0, "lo").when(e % 5 == 0, "eth0").otherwise("")
    src = F.format_string("203.0.%d.%d", F.floor(u / 256).cast("bigint"), u % 256)
    proto = F.when(e % 10 == 0, "ICMP").when(e % 10 < 4, "UDP").otherwise("TCP")
    spt = (F.lit(1024) + (e * 7919) % 60000).cast("string")
    dpt = F.element_at(F.array(*[F.lit(p) for p in FIXTURE_PORTS]), (F.pmod(k, F.lit(8)) + 1).cast("int")).cast("string")
    ports = (F.when(proto == "ICMP", F.lit("TYPE=3 CODE=3 "))
              .when(proto == "TCP", F.concat(F.lit("SPT="), spt, F.lit(" DPT="), dpt,
                                             F.lit(" WINDOW=512 RES=0x00 SYN URGP=0 ")))
              .otherwise(F.concat(F.lit("SPT="), spt, F.lit(" DPT="), dpt, F.lit(" LEN=20 "))))
    packet = F.concat(
        header, F.lit(" fw kernel: ["), e.cast("string"), F.lit(".000000] IPT: "), action,
        F.lit(" IN="), if_in, F.lit(" OUT="), if_out, F.lit(" MAC=" + FIXTURE_MAC + "  SRC="), src,
        F.lit(" DST=188.126.93."), (e % 4).cast("string"),
        F.lit(" LEN=40 TOS=0x00 TTL=56 ID="), (e % 65536).cast("string"), F.lit(" PROTO="), proto, F.lit(" "),
        ports,
        F.when(e % 20 == 0, F.lit(INNER_PACKET)).otherwise(F.lit("")),
        F.when(e % 103 == 0, F.lit("ACTION=DROP ")).otherwise(F.lit("")),
    )
    noise = F.concat(header, F.lit(" fw kernel: usb 1-1: reset"))
    return events.select(e.alias("event_id"), F.when(e % 101 == 0, noise).otherwise(packet).alias("value"))


# One writer at a time per process for the cached derived tables.
BUILD_LOCK = threading.RLock()


def fixture_log_path(spark: SparkSession, sf_dir: str) -> str:
    """Text files rendered from ``events`` of ``sf_dir`` (written once, then reused)."""
    path = scratch_path(spark, "fixtures", _key(sf_dir), "syslog")
    with BUILD_LOCK:
        _build_log(spark, sf_dir, path)
    return path


def _build_log(spark: SparkSession, sf_dir: str, path: str) -> None:
    if not path_exists(spark, path + "/_SUCCESS"):
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "8")) // 2)
        with jit_sized_codegen(spark):
            (render_syslog(events)
             .repartitionByRange(files, "event_id")
             .sortWithinPartitions("event_id")
             .select("value")
             .write.mode("overwrite").text(path))


def host_cache_from_customers(customer: DataFrame, now=FIXTURE_NOW) -> DataFrame:
    """Host table: ip from the customer key, every fourth a failed lookup,
    write times spread over 400 hours before ``now``."""
    c = F.col("c_custkey")
    ip = F.lit(203 * 16777216) + F.floor(c / 256).cast("bigint") * 256 + c % 256
    host = F.when(c % 4 == 0, long_to_ip(ip)).otherwise(
        F.concat(F.lit("host-"), c.cast("string"), F.lit(".cust.provider.example.org")))
    ttl = ntz_literal(now) - F.make_dt_interval(F.lit(0), (c % 400).cast("int"))
    return customer.select(ip.cast("bigint").alias("ip"), host.alias("host"), ttl.alias("ttl"))
