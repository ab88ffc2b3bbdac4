"""Coordinate conversions as native Spark column expressions.

Everything here returns `Column`s built from `pyspark.sql.functions`, so the
conversions run inside whole-stage codegen on the executors; there is no UDF
and no per-row Python.

Three systems are used by the analyses:

* WGS-84 longitude / latitude in degrees (the input pings),
* Web-Mercator metres (EPSG:3857) for distance joins and tiles,
* UTM zone 50 north metres (EPSG:32650) for the fishnet zone counts,

plus the GCJ-02 offset used by some Chinese map providers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import col_of

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to agree)
# ---------------------------------------------------------------------------
# Web-Mercator sphere radius, metres.
MERCATOR_RADIUS = 6378137.0
# WGS-84 ellipsoid for UTM: semi-major axis and inverse flattening.
WGS84_A = 6378137.0
WGS84_INV_F = 298.257223563
# UTM zone 50 north: central meridian 117 E, scale 0.9996, false easting 500000 m.
UTM50_LON0_DEG = 117.0
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
# GCJ-02 offset model: axis 6378245.0, eccentricity squared 0.00669342162296594323,
# origin of the polynomial at lon 105, lat 35; inverse loop stops when both
# coordinate changes are <= 1e-7 degrees, and runs at most 6 rounds.
GCJ_AXIS = 6378245.0
GCJ_EE = 0.00669342162296594323
GCJ_LON_ORIGIN = 105.0
GCJ_LAT_ORIGIN = 35.0
GCJ_TOLERANCE = 1e-7
GCJ_MAX_ROUNDS = 6


# ---------------------------------------------------------------------------
# Web-Mercator
# ---------------------------------------------------------------------------
def mercator_x(lng) -> Column:
    """Longitude (degrees) -> Web-Mercator x (metres)."""
    return F.radians(col_of(lng)) * F.lit(MERCATOR_RADIUS)


def mercator_y(lat) -> Column:
    """Latitude (degrees) -> Web-Mercator y (metres).

    `ln` is nullable in Spark (null for arguments <= 0, i.e. at the poles);
    the NaN default keeps the column non-nullable, so the optimizer does not
    infer `isnotnull(y)` filters that would evaluate the projection twice.
    """
    y = F.ln(F.tan(F.lit(math.pi) / 4 + F.radians(col_of(lat)) / 2)) * F.lit(MERCATOR_RADIUS)
    return F.coalesce(y, F.lit(float("nan")))


def mercator_lng(x) -> Column:
    """Web-Mercator x (metres) -> longitude (degrees)."""
    return F.degrees(col_of(x) / F.lit(MERCATOR_RADIUS))


def mercator_lat(y) -> Column:
    """Web-Mercator y (metres) -> latitude (degrees)."""
    return F.degrees(F.lit(2.0) * F.atan(F.exp(col_of(y) / F.lit(MERCATOR_RADIUS))) - F.lit(math.pi) / 2)


def non_null(c: Column) -> Column:
    """NaN instead of null: projected coordinates stay non-nullable, so the
    optimizer infers no `isnotnull` guards that would re-evaluate the whole
    projection inside the scan filter.  A NaN point fails every distance and
    containment test, exactly like a null one."""
    return F.coalesce(c, F.lit(float("nan")))


def finite(x="x", y="y") -> Column:
    """Both coordinates are finite: a position outside the projection's range is not."""
    limit = F.lit(1e300)
    return (F.abs(col_of(x)) < limit) & (F.abs(col_of(y)) < limit) & ~F.isnan(col_of(x)) & ~F.isnan(col_of(y))


def to_mercator(df: DataFrame, lng: str = "lng", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Add Web-Mercator columns `x`, `y` computed from `lng`, `lat`."""
    return df.withColumns({x: non_null(mercator_x(lng)), y: mercator_y(lat)})


# ---------------------------------------------------------------------------
# UTM (transverse Mercator, Krueger series to third order in n)
# ---------------------------------------------------------------------------
def _utm_constants(lon0_deg: float):
    f = 1.0 / WGS84_INV_F
    n = f / (2.0 - f)
    big_a = WGS84_A / (1.0 + n) * (1.0 + n * n / 4.0 + n ** 4 / 64.0)
    alpha = (
        n / 2.0 - 2.0 * n * n / 3.0 + 5.0 * n ** 3 / 16.0,
        13.0 * n * n / 48.0 - 3.0 * n ** 3 / 5.0,
        61.0 * n ** 3 / 240.0,
    )
    ecc = 2.0 * math.sqrt(n) / (1.0 + n)
    return big_a, alpha, ecc, math.radians(lon0_deg)


def utm_xy(lng, lat, lon0_deg: float = UTM50_LON0_DEG, false_northing: float = 0.0) -> tuple[Column, Column]:
    """Longitude / latitude (degrees) -> (easting, northing) in metres.

    Transverse Mercator by the Krueger n-series (third order), the textbook
    form used for UTM; accurate to well under a millimetre inside a zone.
    """
    big_a, alpha, ecc, lam0 = _utm_constants(lon0_deg)
    phi = F.radians(col_of(lat))
    dlam = F.radians(col_of(lng)) - F.lit(lam0)
    sphi = F.sin(phi)
    t = F.sinh(F.atanh(sphi) - F.lit(ecc) * F.atanh(F.lit(ecc) * sphi))
    xi = F.atan2(t, F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(F.lit(1.0) + t * t))
    east_sum = eta
    north_sum = xi
    for j, a_j in enumerate(alpha, start=1):
        east_sum = east_sum + F.lit(a_j) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north_sum = north_sum + F.lit(a_j) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k0a = UTM_K0 * big_a
    east = F.lit(UTM_FALSE_EASTING) + F.lit(k0a) * east_sum
    north = F.lit(false_northing) + F.lit(k0a) * north_sum
    return east, north


def to_utm50n(df: DataFrame, lng: str = "lng", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Add UTM zone 50N easting / northing columns.

    The two outputs share the `t`, `xi`, `eta` sub-expressions; the helper
    columns are materialised once and dropped so they are not recomputed.
    """
    big_a, alpha, ecc, lam0 = _utm_constants(UTM50_LON0_DEG)
    sphi = F.sin(F.radians(F.col(lat)))
    dlam = F.radians(F.col(lng)) - F.lit(lam0)
    tmp = df.withColumns(
        {
            "_utm_t": F.sinh(F.atanh(sphi) - F.lit(ecc) * F.atanh(F.lit(ecc) * sphi)),
            "_utm_dlam": dlam,
        }
    )
    tmp = tmp.withColumns(
        {
            "_utm_xi": F.atan2(F.col("_utm_t"), F.cos("_utm_dlam")),
            "_utm_eta": F.atanh(F.sin("_utm_dlam") / F.sqrt(F.lit(1.0) + F.col("_utm_t") * F.col("_utm_t"))),
        }
    )
    xi, eta = F.col("_utm_xi"), F.col("_utm_eta")
    east_sum, north_sum = eta, xi
    for j, a_j in enumerate(alpha, start=1):
        east_sum = east_sum + F.lit(a_j) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north_sum = north_sum + F.lit(a_j) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k0a = UTM_K0 * big_a
    out = tmp.withColumns(
        {x: non_null(F.lit(UTM_FALSE_EASTING) + F.lit(k0a) * east_sum), y: non_null(F.lit(k0a) * north_sum)}
    )
    return out.drop("_utm_t", "_utm_dlam", "_utm_xi", "_utm_eta")


def utm50n_parts(parts) -> Column:
    """Project every vertex of a `parts` column (degrees) to UTM 50N metres.

    Lambdas get no common-subexpression elimination, so the projection is
    staged: each `transform` stores its intermediate quantities in a struct and
    the next one reads them, so `t`, `xi` and `eta` are computed once per vertex
    (the same operations, in the same order, as `to_utm50n`).
    """
    big_a, alpha, ecc, lam0 = _utm_constants(UTM50_LON0_DEG)
    k0a = UTM_K0 * big_a

    def stage1(v):
        sphi = F.sin(F.radians(v["y"]))
        return F.struct(
            F.sinh(F.atanh(sphi) - F.lit(ecc) * F.atanh(F.lit(ecc) * sphi)).alias("t"),
            (F.radians(v["x"]) - F.lit(lam0)).alias("dlam"),
        )

    def stage2(s):
        return F.struct(
            F.atan2(s["t"], F.cos(s["dlam"])).alias("xi"),
            F.atanh(F.sin(s["dlam"]) / F.sqrt(F.lit(1.0) + s["t"] * s["t"])).alias("eta"),
        )

    def stage3(s):
        xi, eta = s["xi"], s["eta"]
        east_sum, north_sum = eta, xi
        for j, a_j in enumerate(alpha, start=1):
            east_sum = east_sum + F.lit(a_j) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north_sum = north_sum + F.lit(a_j) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct(
            (F.lit(UTM_FALSE_EASTING) + F.lit(k0a) * east_sum).alias("x"), (F.lit(k0a) * north_sum).alias("y")
        )

    return F.transform(
        col_of(parts), lambda ring: F.transform(F.transform(F.transform(ring, stage1), stage2), stage3)
    )


def utm_sql_text(lng: str, lat: str) -> tuple[str, str]:
    """The same UTM 50N formulas as SQL text (Spark SQL and DuckDB both accept it)."""
    big_a, alpha, ecc, lam0 = _utm_constants(UTM50_LON0_DEG)
    t = (
        f"sinh(atanh(sin(radians({lat}))) - CAST({ecc!r} AS DOUBLE) * "
        f"atanh(CAST({ecc!r} AS DOUBLE) * sin(radians({lat}))))"
    )
    dlam = f"(radians({lng}) - CAST({lam0!r} AS DOUBLE))"
    xi = f"atan2({t}, cos({dlam}))"
    eta = f"atanh(sin({dlam}) / sqrt(CAST(1.0 AS DOUBLE) + {t} * {t}))"
    east, north = eta, xi
    for j, a_j in enumerate(alpha, start=1):
        east = f"({east} + CAST({a_j!r} AS DOUBLE) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta}))"
        north = f"({north} + CAST({a_j!r} AS DOUBLE) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta}))"
    k0a = UTM_K0 * big_a
    return (
        f"(CAST({UTM_FALSE_EASTING!r} AS DOUBLE) + CAST({k0a!r} AS DOUBLE) * {east})",
        f"(CAST({k0a!r} AS DOUBLE) * {north})",
    )


# ---------------------------------------------------------------------------
# GCJ-02
# ---------------------------------------------------------------------------
def _dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _gcj_poly_lat_sql(x: str, y: str) -> str:
    D = _dbl
    return (
        f"({D(-100.0)} + {D(2.0)} * {x} + {D(3.0)} * {y} + {D(0.2)} * {y} * {y} + {D(0.1)} * {x} * {y}"
        f" + {D(0.2)} * sqrt(abs({x}))"
        f" + ({D(20.0)} * sin({D(6.0)} * {x} * pi()) + {D(20.0)} * sin({D(2.0)} * {x} * pi())) * {D(2.0)} / {D(3.0)}"
        f" + ({D(20.0)} * sin({y} * pi()) + {D(40.0)} * sin({y} / {D(3.0)} * pi())) * {D(2.0)} / {D(3.0)}"
        f" + ({D(160.0)} * sin({y} / {D(12.0)} * pi()) + {D(320.0)} * sin({y} * pi() / {D(30.0)})) * {D(2.0)} / {D(3.0)})"
    )


def _gcj_poly_lon_sql(x: str, y: str) -> str:
    D = _dbl
    return (
        f"({D(300.0)} + {x} + {D(2.0)} * {y} + {D(0.1)} * {x} * {x} + {D(0.1)} * {x} * {y}"
        f" + {D(0.1)} * sqrt(abs({x}))"
        f" + ({D(20.0)} * sin({D(6.0)} * {x} * pi()) + {D(20.0)} * sin({D(2.0)} * {x} * pi())) * {D(2.0)} / {D(3.0)}"
        f" + ({D(20.0)} * sin({x} * pi()) + {D(40.0)} * sin({x} / {D(3.0)} * pi())) * {D(2.0)} / {D(3.0)}"
        f" + ({D(150.0)} * sin({x} / {D(12.0)} * pi()) + {D(300.0)} * sin({x} / {D(30.0)} * pi())) * {D(2.0)} / {D(3.0)})"
    )


def gcj_delta_sql(lng: str, lat: str) -> tuple[str, str]:
    """GCJ-02 offset (d_lng, d_lat) as SQL text over two column expressions.

    One text serves Spark (parsed once by `F.expr`) and the DuckDB oracle, so
    both evaluate the same operations in the same order.
    """
    D = _dbl
    x = f"({lng} - {D(GCJ_LON_ORIGIN)})"
    y = f"({lat} - {D(GCJ_LAT_ORIGIN)})"
    rad = f"({lat} / {D(180.0)} * pi())"
    magic = f"({D(1.0)} - {D(GCJ_EE)} * sin({rad}) * sin({rad}))"
    d_lat = f"(({_gcj_poly_lat_sql(x, y)} * {D(180.0)}) / (({D(GCJ_AXIS * (1 - GCJ_EE))} / ({magic} * sqrt({magic}))) * pi()))"
    d_lng = f"(({_gcj_poly_lon_sql(x, y)} * {D(180.0)}) / ({D(GCJ_AXIS)} / sqrt({magic}) * cos({rad}) * pi()))"
    return d_lng, d_lat


def gcj_delta(lng: str, lat: str) -> tuple[Column, Column]:
    """GCJ-02 offset (d_lng, d_lat) in degrees at a WGS-84 position (column names)."""
    d_lng, d_lat = gcj_delta_sql(f"`{lng}`", f"`{lat}`")
    return F.expr(d_lng), F.expr(d_lat)


def wgs84_to_gcj02(df: DataFrame, lng: str = "lng", lat: str = "lat", out_lng: str = "gcj_lng", out_lat: str = "gcj_lat") -> DataFrame:
    """Forward shift: GCJ position = WGS position + offset."""
    tmp = df.withColumns(dict(zip(("_gd_lng", "_gd_lat"), gcj_delta(lng, lat))))
    return tmp.withColumns(
        {out_lng: F.col(lng) + F.col("_gd_lng"), out_lat: F.col(lat) + F.col("_gd_lat")}
    ).drop("_gd_lng", "_gd_lat")


def gcj02_to_wgs84(df: DataFrame, lng: str = "lng", lat: str = "lat", out_lng: str = "wgs_lng", out_lat: str = "wgs_lat") -> DataFrame:
    """Inverse shift by fixed-point iteration, unrolled into chained projections.

    Round 0 always runs (its change is measured against the raw input, which is
    never within tolerance away from the origin); each later round computes the
    offset at the current estimate, moves to `input - offset`, and marks the row
    done once both coordinates moved by at most the tolerance.  At most
    `GCJ_MAX_ROUNDS` rounds run.  One `withColumns` per round keeps every
    projection small; a finished row just carries its value forward.
    """
    g_lng, g_lat = F.col(lng), F.col(lat)
    d_lng, d_lat = gcj_delta(lng, lat)
    cur = df.withColumns(
        {
            "_gw_lng": g_lng - d_lng,
            "_gw_lat": g_lat - d_lat,
            "_gw_done": (F.abs(g_lng) <= GCJ_TOLERANCE) & (F.abs(g_lat) <= GCJ_TOLERANCE),
        }
    )
    for _ in range(1, GCJ_MAX_ROUNDS):
        d_lng, d_lat = gcj_delta("_gw_lng", "_gw_lat")
        # a finished row needs no further offset
        open_row = ~F.col("_gw_done")
        cur = cur.withColumns({"_gw_dlng": F.when(open_row, d_lng).otherwise(F.lit(0.0)), "_gw_dlat": F.when(open_row, d_lat).otherwise(F.lit(0.0))})
        new_lng = g_lng - F.col("_gw_dlng")
        new_lat = g_lat - F.col("_gw_dlat")
        moved_small = (F.abs(new_lng - F.col("_gw_lng")) <= GCJ_TOLERANCE) & (
            F.abs(new_lat - F.col("_gw_lat")) <= GCJ_TOLERANCE
        )
        done = F.col("_gw_done")
        cur = cur.select(
            *[c for c in cur.columns if c not in ("_gw_lng", "_gw_lat", "_gw_done", "_gw_dlng", "_gw_dlat")],
            F.when(done, F.col("_gw_lng")).otherwise(new_lng).alias("_gw_lng"),
            F.when(done, F.col("_gw_lat")).otherwise(new_lat).alias("_gw_lat"),
            (done | moved_small).alias("_gw_done"),
        )
    return cur.withColumnsRenamed({"_gw_lng": out_lng, "_gw_lat": out_lat}).drop("_gw_done")
