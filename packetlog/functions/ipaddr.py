"""IPv4 text <-> unsigned 32-bit number, as column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One octet, 0-255, up to three digits (leading zeros allowed, as MySQL does).
_OCTET = r"(?:[01]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])"
_DOTTED = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ip_to_long(text) -> Column:
    """Dotted quad -> number in [0, 2^32); NULL for anything else (IPv6,
    short forms, octets above 255, empty text). The pattern validates every
    octet, so the conversion itself cannot fail."""
    s = _c(text)
    parts = F.split(s, r"\.")
    octets = [F.element_at(parts, i).cast("bigint") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(s.rlike(_DOTTED), value)


def long_to_ip(number) -> Column:
    """Number -> dotted quad; NULL stays NULL (concat_ws alone would skip it)."""
    n = _c(number)
    parts = [F.shiftright(n, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)]
    return F.when(n.isNotNull(), F.concat_ws(".", *parts))
