"""Row filters on pings: time ranges, slices, study area, season, hour of day.

Time predicates compare the stored `sys_time` column with constants computed
once on the driver, so Spark pushes them into the parquet / CSV scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crs import mercator_x, mercator_y
from ..functions.timefn import (
    date_bounds,
    hour_of_day,
    local_timestamp,
    second_bounds,
)

# The study-area rectangle in degrees (lng_min, lat_min, lng_max, lat_max).
STUDY_AREA = (116.230633649, 39.863608449, 116.44120325, 39.979627788)


def open_range(df: DataFrame, lo_ms: int, hi_ms: int, col: str = "sys_time") -> DataFrame:
    """`lo < t < hi`: both ends open, a ping exactly on a bound is dropped."""
    return df.where((F.col(col) > F.lit(int(lo_ms))) & (F.col(col) < F.lit(int(hi_ms))))


def in_time_range(df: DataFrame, from_time: str, to_time: str, offset_ms: int = 0, col: str = "sys_time") -> DataFrame:
    """Second-precision open range on 'yyyy-MM-dd HH:mm:ss' bounds."""
    lo, hi = second_bounds(from_time, to_time, offset_ms)
    return open_range(df, lo, hi, col)


def in_date_range(df: DataFrame, from_time: str, to_time: str, offset_ms: int = 0, col: str = "sys_time") -> DataFrame:
    """Open range with both bounds cut to midnight of their date."""
    lo, hi = date_bounds(from_time, to_time, offset_ms)
    return open_range(df, lo, hi, col)


def off_slice_edges(df: DataFrame, period_ms: int, offset_ms: int = 0, col: str = "sys_time") -> DataFrame:
    """Drop pings exactly on a slice boundary (open slices lose them)."""
    return df.where(F.pmod(F.col(col) + F.lit(int(offset_ms)), F.lit(int(period_ms))) != 0)


def within_study_area(df: DataFrame, box=STUDY_AREA, x: str = "x", y: str = "y") -> DataFrame:
    """Mercator point strictly inside the (Mercator-projected) study rectangle.

    A lng/lat rectangle stays an axis-aligned rectangle under Mercator, so
    `within` is four strict comparisons.  The corners are projected by the same
    column expressions as the points.
    """
    lng0, lat0, lng1, lat1 = box
    x0, x1 = mercator_x(F.lit(float(lng0))), mercator_x(F.lit(float(lng1)))
    y0, y1 = mercator_y(F.lit(float(lat0))), mercator_y(F.lit(float(lat1)))
    return df.where((F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1))


def in_months(df: DataFrame, months=(12, 1, 2), offset_ms: int = 0, col: str = "sys_time") -> DataFrame:
    """Season filter: calendar month of the local time in `months`."""
    return df.where(F.month(local_timestamp(col, offset_ms)).isin(list(months)))


def at_hour(df: DataFrame, hour: int = 8, offset_ms: int = 0, col: str = "sys_time") -> DataFrame:
    """Local hour of day equals `hour`."""
    return df.where(hour_of_day(col, offset_ms) == hour)
