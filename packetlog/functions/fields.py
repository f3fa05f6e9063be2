"""Small per-field column functions used by the parser, reports and feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32_MAX = 4294967295


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def port_number(text) -> Column:
    """Leading decimal number of a field, 0 when there is none.

    Leading blanks and a plus sign are skipped as a C ``atoi`` does; the value is
    clipped to the unsigned 32-bit column range the packet table stores.
    """
    digits = F.regexp_extract(_c(text), r"^[ \t\n\r\f]*\+?([0-9]+)", 1)
    number = digits.try_cast("bigint")
    return (F.when(digits == "", F.lit(0).cast("bigint"))
             .when(number.isNull() | (number > UINT32_MAX), F.lit(UINT32_MAX).cast("bigint"))
             .otherwise(number))


def shown_interface(if_in="if_in", if_out="if_out") -> Column:
    """The input interface unless it is empty, else the output interface."""
    return F.when(_c(if_in) != "", _c(if_in)).otherwise(_c(if_out))


def trim_host(host, width: int) -> Column:
    """Fit a host name into ``width`` characters keeping its tail (domain and
    top-level part); the first kept character becomes ``*``."""
    h = _c(host)
    return F.when(F.length(h) > width,
                  F.concat(F.lit("*"), F.substring(h, -(width - 1), width - 1))).otherwise(h)
