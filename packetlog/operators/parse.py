"""Packet-line parser: text line -> typed packet columns, with built-in
column functions only (regular expressions run inside whole-stage codegen).

Contract (kept from the original tool):
* only lines containing the marker substring are considered;
* the line is split on runs of spaces; the first token is never taken as the
  marker; the first later token exactly equal to ``IPT:`` is the marker;
* the token right after the marker is the action, whatever it is;
* among the tokens after the action, keys ACTION IN OUT MAC SRC DST PROTO SPT DPT
  are recognised by prefix (``KEY=``, case-sensitive); a repeated key keeps its
  last value (ICMP errors quote an inner packet); ``ACTION=`` overrides the action;
* missing keys give '' (ports 0, addresses NULL); invalid addresses give NULL.
Lines with the substring but without a usable marker token or action are
rejected (the original crashed on them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ipaddr import ip_to_long
from ..functions.fields import port_number
from ..functions.eventtime import syslog_event_time, event_time_before
from ..schema import LOGS_COLUMNS

MARKER_TOKEN = "IPT:"
# First token, then (lazily) the first later token ``IPT:``: tells the two
# kinds of rejected lines apart.
_NO_TOKEN = r"(?s)^ *[^ ]+ (?:.*? )?IPT:(?: |$)"

# The recognised keys.
KEYS = ["ACTION", "IN", "OUT", "MAC", "SRC", "DST", "PROTO", "SPT", "DPT"]


# One pass collects every recognised ``KEY=value`` token after the action, in
# order; reversed, the first position of a key is its last occurrence.
_KEY_TOKEN = " (" + "|".join(KEYS) + ")=([^ ]*)"


def _key_arrays(rest: Column) -> tuple[Column, Column]:
    """(keys, values) of the recognised tokens in ``rest``, last token first."""
    return (F.reverse(F.regexp_extract_all(rest, F.lit(_KEY_TOKEN), 1)),
            F.reverse(F.regexp_extract_all(rest, F.lit(_KEY_TOKEN), 2)))


def _last_value(keys: Column, values: Column, key: str, missing: Column | None = None) -> Column:
    """Value of the last token ``key=...`` (``missing``, default '', when absent)."""
    pos = F.array_position(keys, key)
    return F.when(pos > 0, F.try_element_at(values, pos.cast("int"))).otherwise(
        missing if missing is not None else F.lit(""))


def _marker_split(value: Column) -> tuple[Column, Column]:
    """(action token, text after it). After ``ltrim`` the first token starts
    the line, so the first ``' IPT: '`` is the first marker token that is not
    the first token and has something after it; both are '' without one."""
    line = F.ltrim(value)
    pos = F.locate(" " + MARKER_TOKEN + " ", line)
    tail = F.ltrim(F.substr(line, pos + F.lit(len(MARKER_TOKEN) + 2)))
    action = F.substring_index(tail, " ", 1)
    rest = F.substr(tail, F.length(action) + 1)
    return F.when(pos > 0, action).otherwise(F.lit("")), F.when(pos > 0, rest).otherwise(F.lit(""))


def parse_columns(value: Column) -> dict[str, Column]:
    """Column expressions of one parsed line (strings as in the log). For
    single expressions; ``parse_lines`` stages the same steps for speed."""
    action_token, rest = _marker_split(value)
    keys, values = _key_arrays(rest)
    out = {"ok": action_token != "", "action": _last_value(keys, values, "ACTION", action_token)}
    for k, name in (("IN", "if_in"), ("OUT", "if_out"), ("MAC", "mac"), ("SRC", "src"), ("DST", "dst"),
                    ("PROTO", "proto"), ("SPT", "spt"), ("DPT", "dpt")):
        out[name] = _last_value(keys, values, k)
    return out


def parse_lines(lines: DataFrame, value: str = "value", year=None, keep=(), zone: str | None = None) -> DataFrame:
    """Parse marker lines; returns packet-table columns plus ``ok`` (False for
    rejects) and the columns named in ``keep``. ``id`` is kept when present.
    ``year`` fills ``timestamp`` from the syslog header: an int or column, or
    ``"auto"`` (from the file's modification time, needs the
    ``file_modification_time`` column of ``read_syslog``); NULL when None.
    ``zone`` is the log host's time zone for ``"auto"`` (default: the session's).

    Four projections: marker split, the key/value arrays (two regular
    expression passes over the tail of the line), raw strings, typed values. Catalyst keeps
    them apart (a costly expression used several times is not inlined), so
    each runs once per line, all in one codegen stage.
    """
    v = F.col(value)
    carry = (["id"] if "id" in lines.columns else []) + [k for k in keep if k != value]
    action_token, rest = _marker_split(v)
    if isinstance(year, str) and year == "auto":
        mtime = F.col("file_modification_time").cast("timestamp_ntz")
        if zone:
            mtime = F.convert_timezone(None, F.lit(zone), mtime)
        ts = event_time_before(v, mtime)
    elif year is not None:
        ts = syslog_event_time(v, year)
    else:
        ts = F.lit(None).cast("timestamp_ntz")
    step1 = lines.select(*carry, v.alias("_value"), ts.alias("timestamp"),
                         action_token.alias("_action"), rest.alias("_rest"))
    keys, values = _key_arrays(F.col("_rest"))
    step2 = step1.select(*carry, "_value", "timestamp", "_action", keys.alias("_keys"), values.alias("_values"))
    k, vals = F.col("_keys"), F.col("_values")
    # Raw strings first, conversions after: a lookup used several times by a
    # conversion is computed once, and each generated method stays small
    # enough for the JIT compiler.
    step3 = step2.select(
        *carry, "timestamp", "_action",
        *[_last_value(k, vals, key).alias("_" + key.lower()) for key in KEYS if key != "ACTION"],
        _last_value(k, vals, "ACTION", F.col("_action")).alias("action"),
        *(["_value"] if value in keep else []))
    step3 = step3.select(
        *carry,
        F.col("timestamp"),
        F.col("_in").alias("if_in"),
        F.col("_out").alias("if_out"),
        ip_to_long("_src").alias("src_ip"),
        port_number("_spt").alias("src_prt"),
        ip_to_long("_dst").alias("dst_ip"),
        port_number("_dpt").alias("dst_prt"),
        F.col("_proto").alias("proto"),
        F.col("action"),
        F.col("_mac").alias("mac"),
        (F.col("_action") != "").alias("ok"),
        *([F.col("_value").alias(value)] if value in keep else []),
    )
    return step3


def packets(parsed: DataFrame) -> DataFrame:
    """Accepted rows in packet-table layout."""
    return parsed.where("ok").select(*[c for c in LOGS_COLUMNS if c in parsed.columns])


def rejects(parsed_with_value: DataFrame, value: str = "value") -> DataFrame:
    """Rejected lines with a reason: no marker token, or nothing after it."""
    v = F.col(value)
    reason = F.when(v.rlike(_NO_TOKEN), F.lit("no_action")).otherwise(F.lit("no_marker_token"))
    return parsed_with_value.where(~F.col("ok")).select(
        *([F.col("id")] if "id" in parsed_with_value.columns else []), v.alias("line"), reason.alias("reason"))
