"""Syslog event time and the age tests of the host table."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Syslog month abbreviations, in calendar order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def syslog_event_time(line, year) -> Column:
    """``Mmm dd HH:MM:SS`` at the start of a syslog line -> TIMESTAMP_NTZ.

    Syslog writes no year, so the caller passes it (an int or a column, e.g.
    derived from the file's modification time). Space-padded days (``May  4``)
    and unpadded ones are accepted. Anything that is not a valid date gives
    NULL. Plain string slicing, no regular expression.
    """
    s = _c(line)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(s, 1, 3))
    after = F.ltrim(F.substring(s, 4, 16))                 # "d HH:MM:SS ..." or "dd HH:MM:SS ..."
    day_text = F.substring_index(after, " ", 1)
    clock = F.substring(after, F.length(day_text) + 2, 9)  # "HH:MM:SS" and the next character
    well_formed = ((F.substring(s, 4, 1) == " ") & (F.substring(clock, 3, 1) == ":")
                   & (F.substring(clock, 6, 1) == ":") & F.substring(clock, 9, 1).isin("", " "))
    part = lambda a, n: F.substring(clock, a, n).try_cast("int")
    ts = F.try_make_timestamp_ntz(_lit(year), month.cast("int"), day_text.try_cast("int"), part(1, 2), part(4, 2),
                                  part(7, 2).cast("decimal(16,6)"))
    return F.when((month > 0) & well_formed, ts)


def event_time_before(line, reference, tolerance_hours: int = 24) -> Column:
    """Event time of a line without a year, next to ``reference`` (the file's
    modification time on the log host's clock): the reference's year, or the
    year before if that would be later than the reference by more than the
    tolerance (clocks and zones differ) or no date at all (29 February)."""
    r = _c(reference)
    latest = r + F.make_dt_interval(F.lit(0), F.lit(int(tolerance_hours)))
    same, before = syslog_event_time(line, F.year(r)), syslog_event_time(line, F.year(r) - 1)
    return F.when(same <= latest, same).otherwise(before)


def utc_now() -> _dt.datetime:
    """The present in UTC, without a zone: the clock of stored ``ttl`` values."""
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def hours_before(now, hours: int) -> Column:
    """``now - hours`` as a timestamp column; ``now`` is a datetime or column."""
    base = ntz_literal(now if now is not None else utc_now())
    return base - F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def is_fresh(ttl, now, hours: int) -> Column:
    """Cache read test: written strictly later than ``now - hours``."""
    return _c(ttl) > hours_before(now, hours)


def survives_prune(ttl, now, hours: int) -> Column:
    """Cache prune keeps rows not strictly older than ``now - hours``; a NULL
    time survives (the delete predicate is unknown for it)."""
    return F.coalesce(_c(ttl) >= hours_before(now, hours), F.lit(True))


def ntz_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal; a datetime with a zone is converted to UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    if value.tzinfo is not None:
        value = value.astimezone(_dt.timezone.utc)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
