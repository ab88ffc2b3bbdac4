"""Spatial inputs derived from the driver's parquet tables.

The driver tables carry no coordinates, so every spatial input is computed
from them by deterministic arithmetic.  Pings grow with `events` (one ping per
event), POIs with `supplier`, cases with `customer`; roads and zones come from
`nation` (25 rows at every scale).

The formulas and constants below are the agreed fixture definitions; the
DuckDB oracle in `plans/oracle.py` uses the same text so both engines produce
bit-identical doubles.
"""

from __future__ import annotations

import datetime as _dt
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crs import mercator_x, mercator_y, utm50n_parts
from ..functions.geom import PARTS_TYPE
from ..functions.timefn import MS_PER_DAY, sys_time_from_timestamp

# Fixture boxes and multipliers (lng/lat degrees).
PING_LNG0, PING_LAT0, PING_DLNG, PING_DLAT = 116.20, 39.80, 0.30, 0.25
POI_LNG0, POI_LAT0, POI_DLNG, POI_DLAT = 116.20, 39.80, 0.30, 0.25
CASE_FIRST_DATE = "2024-01-01"
ROAD_VERTICES = 4
ZONE_VERTICES = 6


def non_null_coordinates(df: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Drop rows without a position.  Besides the semantics (a ping without
    coordinates joins nothing), the filter marks `lng` / `lat` non-nullable, so
    the optimizer infers no `isnotnull` guards on projected coordinates and cell
    keys (which would re-evaluate whole projections inside the scan filter)."""
    return df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _frac(expr: str, modulus: int) -> F.Column:
    return F.expr(f"cast(({expr}) % {modulus} as double)") / F.lit(float(modulus))


def ltz_literal(ms: int) -> F.Column:
    """TIMESTAMP (instant) literal at epoch milliseconds `ms` (constant-folded)."""
    return F.timestamp_millis(F.lit(int(ms)))


def ntz_literal(ms: int) -> F.Column:
    """TIMESTAMP_NTZ literal at epoch milliseconds `ms` (wall time, no zone)."""
    d = _dt.datetime(1970, 1, 1) + _dt.timedelta(milliseconds=int(ms))
    return F.expr(f"timestamp_ntz'{d.isoformat(sep=' ', timespec='milliseconds')}'")


def pings(spark: SparkSession, sf_dir: str, window: tuple[int, int] | None = None) -> DataFrame:
    """`(ping_id, user_id, sys_time, lng, lat)` - one ping per event.

    Rows without id or time are dropped, so the coordinates are non-nullable.
    `window=(lo_ms, hi_ms)` adds a superset bound on the stored `ts` column
    (pushed into the parquet scan, skips row groups); the exact bound on
    `sys_time` is applied by the caller.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    ev = ev.where(F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    # the stored wall-clock value in ms, whichever timestamp type the session
    # reads it as: NTZ -> difference from the NTZ epoch; LTZ -> the instant's
    # micros (no session time zone involved either way)
    ntz = isinstance(ev.schema["ts"].dataType, T.TimestampNTZType)
    if window is not None:
        lo, hi = window
        lit_lo, lit_hi = (ntz_literal(lo - 1), ntz_literal(hi + 1)) if ntz else (ltz_literal(lo - 1), ltz_literal(hi + 1))
        ev = ev.where((F.col("ts") >= lit_lo) & (F.col("ts") < lit_hi))
    sys_time = sys_time_from_timestamp("ts") if ntz else F.expr("unix_micros(`ts`) div 1000")
    return ev.select(
        F.col("event_id").alias("ping_id"),
        F.col("user_id"),
        sys_time.alias("sys_time"),
        (F.lit(PING_LNG0) + _frac("event_id*7919 + user_id*104729", 100003) * F.lit(PING_DLNG)).alias("lng"),
        (F.lit(PING_LAT0) + _frac("event_id*15485863 + user_id*32452843", 100019) * F.lit(PING_DLAT)).alias("lat"),
    ).transform(non_null_coordinates)


def wide_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings over more than a year and well beyond the study boxes, one per event.

    A season filter, the hourly-grid box and the Beijing box each lose some of
    them, and most hours of the year have none.
    """
    p = pings(spark, sf_dir)
    months = F.expr("cast((ping_id * 7) % 13 as bigint)")
    return p.select(
        "ping_id",
        (F.col("sys_time") + months * F.lit(30 * MS_PER_DAY)).alias("sys_time"),
        (F.lit(115.2) + _frac("ping_id*7919", 100003) * F.lit(2.4)).alias("lng"),
        (F.lit(39.2) + _frac("ping_id*15485863", 100019) * F.lit(1.6)).alias("lat"),
    ).transform(non_null_coordinates)


def pois(spark: SparkSession, sf_dir: str, with_name: bool = False) -> DataFrame:
    """`(feature_id, lng, lat)` - one POI per supplier (`name` too if asked)."""
    cols = ["s_suppkey", "s_name"] if with_name else ["s_suppkey"]
    s = table(spark, sf_dir, "supplier").select(*cols).where(F.col("s_suppkey").isNotNull())
    extra = [F.col("s_name").alias("name")] if with_name else []
    return s.select(
        F.col("s_suppkey").alias("feature_id"),
        *extra,
        (F.lit(POI_LNG0) + _frac("s_suppkey*611953", 10007) * F.lit(POI_DLNG)).alias("lng"),
        (F.lit(POI_LAT0) + _frac("s_suppkey*746773", 10009) * F.lit(POI_DLAT)).alias("lat"),
    ).transform(non_null_coordinates)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(case_id, case_date, lng, lat)` - one dated infected place per customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey").where(F.col("c_custkey").isNotNull())
    return c.select(
        F.col("c_custkey").alias("case_id"),
        F.date_add(F.lit(CASE_FIRST_DATE).cast("date"), F.expr("cast((c_custkey*7) % 30 as int)")).alias("case_date"),
        (F.lit(116.20) + _frac("c_custkey*49979687", 10037) * F.lit(0.30)).alias("lng"),
        (F.lit(39.80) + _frac("c_custkey*86028121", 10039) * F.lit(0.25)).alias("lat"),
    ).transform(non_null_coordinates)


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey").isNotNull())
    return n.select(F.col("n_nationkey").cast("long").alias("feature_id"))


def road_vertex_lng(k):
    return (
        F.lit(116.22)
        + F.expr("cast((feature_id*37) % 25 as double)") / F.lit(25.0) * F.lit(0.22)
        + k * F.lit(0.008)
    )


def road_vertex_lat(k):
    return (
        F.lit(39.82)
        + F.expr("cast((feature_id*11) % 25 as double)") / F.lit(25.0) * F.lit(0.18)
        + F.pmod(F.col("feature_id") * (k + 3), F.lit(7)).cast("double") * F.lit(0.004)
    )


def roads_lnglat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(feature_id, kind, parts)` road lines in degrees, one 4-vertex line per nation."""
    n = _nation(spark, sf_dir)
    line = F.transform(
        F.sequence(F.lit(0), F.lit(ROAD_VERTICES - 1)),
        lambda k: F.struct(road_vertex_lng(k.cast("long")).alias("x"), road_vertex_lat(k.cast("long")).alias("y")),
    )
    return n.select("feature_id", F.lit("LINESTRING").alias("kind"), F.array(line).cast(PARTS_TYPE).alias("parts"))


def wide_roads_lnglat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 4-vertex line per supplier, spread over more than the Beijing box; every
    third line goes by the text id of its neighbour, so text ids repeat."""
    s = table(spark, sf_dir, "supplier").where(F.col("s_suppkey").isNotNull()).select(F.col("s_suppkey").cast("long").alias("feature_id"))
    line = F.transform(
        F.sequence(F.lit(0), F.lit(ROAD_VERTICES - 1)),
        lambda k: F.struct(
            (F.lit(115.7) + _frac("feature_id*611953", 10007) * F.lit(1.4) + k.cast("double") * F.lit(0.02)).alias("x"),
            (F.lit(39.4) + _frac("feature_id*746773", 10009) * F.lit(1.1) + F.pmod(F.col("feature_id") * (k + 3), F.lit(7)).cast("double") * F.lit(0.006)).alias("y"),
        ),
    )
    text_id = F.concat(F.lit("R-"), F.when(F.col("feature_id") % 3 == 0, F.col("feature_id") + 1).otherwise(F.col("feature_id")).cast("string"))
    return s.select("feature_id", text_id.alias("text_id"), F.lit("LINESTRING").alias("kind"), F.array(line).cast(PARTS_TYPE).alias("parts"))


def blocks_lnglat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-polygons of very different sizes, one per supplier: a square with a square
    hole, and a second, smaller square inside that hole.  The rings' orientation changes
    with the key."""
    s = table(spark, sf_dir, "supplier").where(F.col("s_suppkey").isNotNull()).select(F.col("s_suppkey").cast("long").alias("feature_id"))
    cx = F.lit(116.20) + _frac("feature_id*49979687", 10037) * F.lit(0.30)
    cy = F.lit(39.80) + _frac("feature_id*86028121", 10039) * F.lit(0.25)
    half = F.lit(0.0005) * F.pow(F.lit(2.0), F.expr("cast(feature_id % 7 as double)"))

    def square(part: float):
        h = half * F.lit(part)
        at = lambda sx, sy: F.struct((cx + F.lit(sx) * h).alias("x"), (cy + F.lit(sy) * h).alias("y"))
        ring = F.array(at(-1.0, -1.0), at(1.0, -1.0), at(1.0, 1.0), at(-1.0, 1.0), at(-1.0, -1.0))
        return F.when(F.col("feature_id") % 2 == 0, F.reverse(ring)).otherwise(ring)

    parts = F.array(square(1.0), square(0.5), square(0.25))
    return s.select("feature_id", F.lit("MULTIPOLYGON").alias("kind"), parts.cast(PARTS_TYPE).alias("parts"))


def _zone_ring(k):
    ang = k.cast("double") * F.lit(math.pi) / F.lit(3.0)
    return F.struct(
        (
            F.lit(116.35)
            + F.expr("cast((feature_id*37)%25 as double)") / F.lit(25.0) * F.lit(0.2)
            - F.lit(0.1)
            + F.lit(0.02) * F.cos(ang)
        ).alias("x"),
        (
            F.lit(39.92)
            + F.expr("cast((feature_id*11)%25 as double)") / F.lit(25.0) * F.lit(0.16)
            - F.lit(0.08)
            + F.lit(0.015) * F.sin(ang)
        ).alias("y"),
    )


def zones_lnglat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(feature_id, kind, parts)` overlapping hexagons in degrees, closed rings."""
    n = _nation(spark, sf_dir)
    ring = F.transform(F.sequence(F.lit(0), F.lit(ZONE_VERTICES - 1)), _zone_ring)
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return n.select("feature_id", F.lit("POLYGON").alias("kind"), F.array(closed).cast(PARTS_TYPE).alias("parts"))


def project_parts(df: DataFrame, system: str = "mercator", parts: str = "parts") -> DataFrame:
    """Project every vertex of `parts` (degrees) to `mercator` or `utm50n` metres.

    Shape tables are small and each row is projected in place with
    `transform`, so there is no explode / regroup shuffle.
    """
    if system == "mercator":
        proj = F.transform(
            F.col(parts),
            lambda ring: F.transform(ring, lambda v: F.struct(mercator_x(v["x"]).alias("x"), mercator_y(v["y"]).alias("y"))),
        )
        return df.withColumn(parts, proj)
    if system == "utm50n":
        return df.withColumn(parts, utm50n_parts(parts))
    raise ValueError(f"unknown system {system!r}")
