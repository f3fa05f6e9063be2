"""Randomised check of the parser against a plain-Python model of the
tokenising rules (split on spaces, first token never the marker, first later
``IPT:`` token, action = next token, last ``KEY=`` wins, ACTION= overrides)."""

import uuid

from hypothesis import given, settings, strategies as st

from loglines import write_lines
from packetlog.operators.parse import KEYS
from packetlog.plans.ingest import parse_log
from packetlog.sources.syslog import read_syslog


def model(line):
    if "IPT: " not in line:
        return None
    toks = [t for t in line.split(" ") if t]
    try:
        i = toks.index("IPT:", 1)
    except ValueError:
        return "reject"
    if i + 1 >= len(toks):
        return "reject"
    action = toks[i + 1]
    vals = {k: "" for k in KEYS}
    seen_action = False
    for t in toks[i + 2:]:
        for k in KEYS:
            if t.startswith(k + "="):
                vals[k] = t[len(k) + 1:]
                seen_action = seen_action or k == "ACTION"
                break
    return {"action": vals["ACTION"] if seen_action else action, "if_in": vals["IN"], "if_out": vals["OUT"],
            "mac": vals["MAC"], "proto": vals["PROTO"], "src": vals["SRC"], "dst": vals["DST"],
            "spt": vals["SPT"], "dpt": vals["DPT"]}


def ip_model(s):
    parts = s.split(".")
    if len(parts) != 4 or not all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return None
    a, b, c, d = (int(p) for p in parts)
    return a * 16777216 + b * 65536 + c * 256 + d


def port_model(s):
    s = s.lstrip(" \t\n\r\f")
    if s.startswith("+"):
        s = s[1:]
    digits = ""
    for ch in s:
        if not ch.isdigit():
            break
        digits += ch
    return min(int(digits), 4294967295) if digits else 0


value = st.sampled_from(["", "eth0", "lo", "1.2.3.4", "255.255.255.255", "256.0.0.1", "10.0.0", "::1", "80", "12ab",
                         "x=y", "DROP", "TCP", "a\tb"])
key_token = st.builds(lambda k, v: f"{k}={v}", st.sampled_from(KEYS + ["XIN", "SRCX", "[SRC", "LEN"]), value)
token = st.one_of(key_token, st.sampled_from(["IPT:", "XIPT:", "IPT:x", "kernel:", "[1.0]", "ACCEPT", "DROP", "CBLK",
                                              "IN=eth1", "ACTION=", "\t"]))
line = st.builds(lambda head, toks, seps: head + "".join(s + t for s, t in zip(seps, toks)),
                 st.sampled_from(["May  4 06:35:08 fw", "IPT:", "  host", "x"]),
                 st.lists(token, min_size=0, max_size=14),
                 st.lists(st.sampled_from([" ", "  ", " "]), min_size=14, max_size=14))


@settings(max_examples=6, deadline=None)
@given(st.lists(line, min_size=20, max_size=60))
def test_parser_matches_model(spark, lines):
    import os
    import tempfile
    d = os.path.join(tempfile.gettempdir(), "packetlog-model-" + uuid.uuid4().hex)
    write_lines(d, "a.log", [ln.replace("\n", " ") for ln in lines])
    rows = parse_log(read_syslog(spark, d), keep_lines=True).orderBy("id").collect()
    expected = [(ln, model(ln)) for ln in lines if model(ln) is not None]
    assert len(rows) == len(expected)
    for r, (ln, m) in zip(rows, expected):
        assert r["value"] == ln
        if m == "reject":
            assert not r["ok"], ln
            continue
        assert r["ok"], ln
        got = (r["action"], r["if_in"], r["if_out"], r["mac"], r["proto"], r["src_ip"], r["dst_ip"], r["src_prt"], r["dst_prt"])
        want = (m["action"], m["if_in"], m["if_out"], m["mac"], m["proto"], ip_model(m["src"]), ip_model(m["dst"]),
                port_model(m["spt"]), port_model(m["dpt"]))
        assert got == want, ln
