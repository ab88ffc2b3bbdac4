"""Slippy-map tile arithmetic on Web-Mercator metres, as column expressions.

Tile numbering: zoom `z` splits the Mercator square into 2^z x 2^z tiles,
x growing east and y growing south from the north-west corner.  Pixels are
256 per tile side.  Conversions to tile numbers truncate toward zero (as an
integer cast does), which differs from floor only outside the world square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import col_of

# Mercator equator length in metres, tile side in pixels,
# default zoom of a lat/lon point, and the tile URL pattern.
EQUATOR = 40075016.68557849
TILE_PIXELS = 256
DEFAULT_POINT_ZOOM = 18
TILE_URL_PREFIX = "https://tile.openstreetmap.org/"
TILE_URL_SUFFIX = ".png"


def _scale(z) -> Column:
    """2^z as a double (exact for every zoom)."""
    return F.pow(F.lit(2.0), _z(z))


def _z(z) -> Column:
    return F.lit(z) if isinstance(z, int) else col_of(z)


def mercator_to_tile(x, y, z) -> tuple[Column, Column]:
    """Mercator metres -> (tile x, tile y) at zoom z (truncating)."""
    s = _scale(z)
    tx = ((col_of(x) + F.lit(EQUATOR / 2.0)) / F.lit(EQUATOR) * s).cast("int")
    ty = ((F.lit(EQUATOR / 2.0) - col_of(y)) / F.lit(EQUATOR) * s).cast("int")
    return tx, ty


def latlon_to_tile(lat, lon, z=DEFAULT_POINT_ZOOM) -> tuple[Column, Column]:
    """Latitude / longitude degrees -> (tile x, tile y) at zoom z (truncating)."""
    s = _scale(z)
    lat_r = F.radians(col_of(lat))
    tx = ((col_of(lon) + 180.0) / 360.0 * s).cast("int")
    ty = ((F.lit(1.0) - F.ln(F.tan(lat_r) + F.lit(1.0) / F.cos(lat_r)) / F.lit(math.pi)) / 2.0 * s).cast("int")
    return tx, ty


def tile_to_mercator(tx, ty, z) -> tuple[Column, Column]:
    """North-west corner of a tile in Mercator metres."""
    s = _scale(z)
    x = col_of(tx).cast("double") * F.lit(EQUATOR) / s - F.lit(EQUATOR / 2.0)
    y = F.lit(EQUATOR / 2.0) - col_of(ty).cast("double") * F.lit(EQUATOR) / s
    return x, y


def tile_to_latlon(tx, ty, z) -> tuple[Column, Column]:
    """North-west corner of a tile in degrees (lat, lon)."""
    s = _scale(z)
    lat = F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - 2.0 * col_of(ty).cast("double") / s))))
    lon = col_of(tx).cast("double") / s * 360.0 - 180.0
    return lat, lon


def tile_url(tx, ty, z) -> Column:
    """Map-tile URL text of a tile (never fetched)."""
    return F.concat(
        F.lit(TILE_URL_PREFIX),
        _z(z).cast("string"),
        F.lit("/"),
        col_of(tx).cast("string"),
        F.lit("/"),
        col_of(ty).cast("string"),
        F.lit(TILE_URL_SUFFIX),
    )


def world_pixel(x, y, z) -> tuple[Column, Column]:
    """Mercator metres -> global pixel (px, py) at zoom z (floor, 256 px per tile).

    Scaling by a power of two is exact in floating point, so the pixel at zoom
    z - k equals the pixel at zoom z shifted right by k; the pyramid builder
    relies on that.
    """
    s = _scale(z) * float(TILE_PIXELS)
    px = F.floor((col_of(x) + F.lit(EQUATOR / 2.0)) / F.lit(EQUATOR) * s)
    py = F.floor((F.lit(EQUATOR / 2.0) - col_of(y)) / F.lit(EQUATOR) * s)
    return px, py
