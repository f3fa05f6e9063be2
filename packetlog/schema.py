"""Stored schemas: the packet table and the IP-to-host table."""

from pyspark.sql import types as T

# Packet table. Addresses are unsigned 32-bit values, so they need a long.
LOGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("if_in", T.StringType(), False),
    T.StructField("if_out", T.StringType(), False),
    T.StructField("src_ip", T.LongType(), True),
    T.StructField("src_prt", T.LongType(), False),
    T.StructField("dst_ip", T.LongType(), True),
    T.StructField("dst_prt", T.LongType(), False),
    T.StructField("proto", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("mac", T.StringType(), False),
])
LOGS_COLUMNS = [f.name for f in LOGS_SCHEMA.fields]

# Host table: one row per address; ``ttl`` is the time the row was written.
# A row whose host equals the dotted address records a failed lookup.
DNS_SCHEMA = T.StructType([
    T.StructField("ip", T.LongType(), False),
    T.StructField("host", T.StringType(), True),
    T.StructField("ttl", T.TimestampNTZType(), True),
])
DNS_COLUMNS = [f.name for f in DNS_SCHEMA.fields]

DEFAULT_LOGS_TABLE = "logs"
DEFAULT_DNS_TABLE = "dns"
