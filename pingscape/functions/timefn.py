"""Epoch-millisecond time helpers.

Pings carry `sys_time`, epoch milliseconds.  Dates and hours are derived by
integer arithmetic with an explicit zone offset (`offset_ms`, default 0 = UTC),
so results never depend on the session time zone.  Range bounds given as text
are converted once on the driver into millisecond constants, which keeps the
predicate on the stored column (parquet row groups can be skipped).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import col_of

MS_PER_SECOND = 1000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000
EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def sys_time_from_timestamp(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column (no zone involved)."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("pass the column name")
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, `{name}`) div 1000")


def local_ms(ms, offset_ms: int = 0) -> Column:
    return col_of(ms) + F.lit(int(offset_ms))


def epoch_day(ms, offset_ms: int = 0) -> Column:
    """Whole days since 1970-01-01 in the zone (floor division)."""
    v = local_ms(ms, offset_ms)
    return ((v - F.pmod(v, F.lit(MS_PER_DAY))) / F.lit(MS_PER_DAY)).cast("int")


def epoch_hour(ms, offset_ms: int = 0) -> Column:
    """Whole hours since the epoch in the zone (floor division)."""
    v = local_ms(ms, offset_ms)
    return ((v - F.pmod(v, F.lit(MS_PER_HOUR))) / F.lit(MS_PER_HOUR)).cast("long")


def day_of(ms, offset_ms: int = 0) -> Column:
    """Calendar date of an epoch-ms value in the zone."""
    return F.date_from_unix_date(epoch_day(ms, offset_ms))


def hour_of_day(ms, offset_ms: int = 0) -> Column:
    """0..23, local hour of day."""
    return (F.pmod(local_ms(ms, offset_ms), F.lit(MS_PER_DAY)) / F.lit(MS_PER_HOUR)).cast("int")


def local_timestamp(ms, offset_ms: int = 0) -> Column:
    """TIMESTAMP_NTZ wall-clock time in the zone (for text output and month())."""
    return F.timestamp_add("MILLISECOND", local_ms(ms, offset_ms), F.expr(EPOCH_NTZ))


def date_text(ms, offset_ms: int = 0) -> Column:
    """'yyyy-MM-dd' of an epoch-ms value in the zone."""
    return F.date_format(local_timestamp(ms, offset_ms), "yyyy-MM-dd")


def time_text(ms, offset_ms: int = 0) -> Column:
    """'HH:mm:ss' of an epoch-ms value in the zone."""
    return F.date_format(local_timestamp(ms, offset_ms), "HH:mm:ss")


def timestamp_text(ms, offset_ms: int = 0) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of an epoch-ms value in the zone."""
    return F.date_format(local_timestamp(ms, offset_ms), "yyyy-MM-dd HH:mm:ss")


def hour_start(hour_index) -> Column:
    """TIMESTAMP_NTZ at the start of an epoch hour index."""
    return F.timestamp_add("HOUR", col_of(hour_index), F.expr(EPOCH_NTZ))


# ---------------------------------------------------------------------------
# driver-side bound constants
# ---------------------------------------------------------------------------
def parse_local(text: str) -> _dt.datetime:
    """Parse 'yyyy-MM-dd HH:mm:ss', 'yyyy-MM-dd HH' or 'yyyy-MM-dd' (naive wall time)."""
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %H", "%Y-%m-%d"):
        try:
            return _dt.datetime.strptime(text.strip(), fmt)
        except ValueError:
            continue
    raise ValueError(f"unrecognised time text: {text!r}")


def to_epoch_ms(text_or_dt, offset_ms: int = 0) -> int:
    """Wall time in the zone -> epoch milliseconds."""
    d = parse_local(text_or_dt) if isinstance(text_or_dt, str) else text_or_dt
    naive_ms = int((d - _dt.datetime(1970, 1, 1)).total_seconds()) * 1000 + d.microsecond // 1000
    return naive_ms - int(offset_ms)


def second_bounds(from_time: str, to_time: str, offset_ms: int = 0) -> tuple[int, int]:
    """Open range bounds with second precision (`sysTime > from AND sysTime < to`)."""
    return to_epoch_ms(from_time, offset_ms), to_epoch_ms(to_time, offset_ms)


def date_bounds(from_time: str, to_time: str, offset_ms: int = 0) -> tuple[int, int]:
    """Open range bounds cut to midnight of each bound's date."""
    a = parse_local(from_time)
    b = parse_local(to_time)
    return (
        to_epoch_ms(_dt.datetime(a.year, a.month, a.day), offset_ms),
        to_epoch_ms(_dt.datetime(b.year, b.month, b.day), offset_ms),
    )


def hour_slices(from_time: str, to_time: str, offset_ms: int = 0) -> tuple[int, int]:
    """Range covered by one-hour slices stepping from `from_time` while before `to_time`.

    Each slice starts at the hour of its step, so the first hour is whole even
    if `from_time` is inside it; the slices end after ceil((to - from) / 1 h)
    steps.  Returned as [lo, hi) epoch-ms hour boundaries.
    """
    a = parse_local(from_time)
    b = parse_local(to_time)
    start_ms = to_epoch_ms(a, offset_ms)
    end_ms = to_epoch_ms(b, offset_ms)
    steps = max(0, -(-(end_ms - start_ms) // MS_PER_HOUR))
    lo = to_epoch_ms(_dt.datetime(a.year, a.month, a.day, a.hour), offset_ms)
    return lo, lo + steps * MS_PER_HOUR


def day_slices(from_time: str, to_time: str, offset_ms: int = 0) -> tuple[int, int]:
    """Range covered by whole-day slices from midnight of the start date.

    The number of slices is the number of whole 24 h periods between the two
    time stamps, so a trailing part-day is not covered.
    """
    a = parse_local(from_time)
    b = parse_local(to_time)
    days = int((b - a).total_seconds() // 86400) if b > a else 0
    lo = to_epoch_ms(_dt.datetime(a.year, a.month, a.day), offset_ms)
    return lo, lo + days * MS_PER_DAY
