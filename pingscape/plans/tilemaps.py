"""Tile-map analyses: tile numbering, tile spans, heat-map and line rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.tiles import latlon_to_tile, mercator_to_tile, tile_to_latlon, tile_to_mercator, tile_url
from ..operators import aggregate, raster
from . import inputs
from . import params as P


def _ping_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.envelope(inputs.pings_mercator(spark, sf_dir)).drop("n")


def _line_env(roads: DataFrame) -> DataFrame:
    v = roads.select(F.explode(geom.vertices("parts")).alias("v"))
    return aggregate.envelope(v.select("v.x", "v.y")).drop("n")


def _road_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_env(inputs.roads_mercator(spark, sf_dir))


def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile of each ping at zoom 18, from lat/lon and from Mercator metres."""
    p = inputs.pings_mercator(spark, sf_dir)
    tx, ty = latlon_to_tile("lat", "lng", 18)
    mtx, mty = mercator_to_tile("x", "y", 18)
    return p.select("ping_id", tx.alias("tx"), ty.alias("ty"), mtx.alias("mtx"), mty.alias("mty"))


def tile_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile holding a ping at `TILE_ZOOM`: corner in metres and degrees, URL."""
    z = P.TILE_ZOOM
    p = inputs.pings_mercator(spark, sf_dir)
    tx, ty = mercator_to_tile("x", "y", z)
    tiles = p.select(tx.alias("tx"), ty.alias("ty")).distinct()
    cx, cy = tile_to_mercator("tx", "ty", z)
    lat, lon = tile_to_latlon("tx", "ty", z)
    return tiles.select(
        F.lit(z).alias("z"),
        "tx",
        "ty",
        F.round(cx, 3).alias("corner_x"),
        F.round(cy, 3).alias("corner_y"),
        F.round(lat, 9).alias("corner_lat"),
        F.round(lon, 9).alias("corner_lng"),
        tile_url("tx", "ty", z).alias("url"),
    )


def tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-left tile of the ping envelope at zooms 0..MAX_ZOOM."""
    return raster.tile_offsets(_ping_env(spark, sf_dir), P.MAX_ZOOM)


def tile_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile span and aligned bounds of the ping envelope per zoom."""
    return _rounded(raster.tile_spans(_ping_env(spark, sf_dir), P.MIN_ZOOM, P.MAX_ZOOM))


def _rounded(s: DataFrame) -> DataFrame:
    return s.select(*[F.round(c, 3).alias(c) if c.startswith(("min_", "max_")) else F.col(c) for c in s.columns])


def heat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blurred heat-map pixels of all pings, zooms MIN_ZOOM..MAX_ZOOM (one job, one scan)."""
    pings = inputs.pings_mercator(spark, sf_dir).select("x", "y")
    return raster.heat_pixels(pings, P.MIN_ZOOM, P.MAX_ZOOM, P.HEAT_BLUR, P.HEAT_CAP)


def heat_pixels_gcj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat map of pings given in GCJ-02, corrected to WGS-84 first."""
    pings = inputs.pings_corrected(spark, sf_dir).select("x", "y")
    return raster.heat_pixels(pings, P.MIN_ZOOM, P.MAX_ZOOM, P.HEAT_BLUR, P.HEAT_CAP)


def tile_offsets_gcj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-left tile of the corrected pings' envelope at zooms 0..MAX_ZOOM."""
    return raster.tile_offsets(aggregate.envelope(inputs.pings_corrected(spark, sf_dir)).drop("n"), P.MAX_ZOOM)


def heat_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty heat-map tiles per zoom."""
    return raster.assemble_tiles(heat_pixels(spark, sf_dir))


def _box_spans(spark: SparkSession) -> DataFrame:
    return raster.tile_spans(raster.box_envelope(spark, P.BEIJING_BOX_3857), P.MIN_ZOOM, P.MAX_ZOOM)


def heat_tiles_beijing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat-map tiles over the fixed Beijing box instead of the data envelope."""
    pings = inputs.pings_mercator(spark, sf_dir).select("x", "y")
    return raster.assemble_tiles(raster.heat_pixels(pings, P.MIN_ZOOM, P.MAX_ZOOM, P.HEAT_BLUR, P.HEAT_CAP, _box_spans(spark)))


def wide_heat_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat-map tiles of the wide pings (they reach beyond the box)."""
    pings = inputs.wide_pings_mercator(spark, sf_dir).select("x", "y")
    return raster.assemble_tiles(raster.heat_pixels(pings, P.MIN_ZOOM, P.MAX_ZOOM, P.HEAT_BLUR, P.HEAT_CAP))


def wide_heat_tiles_beijing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat-map tiles of the wide pings on the Beijing box: those beyond it are cut off."""
    pings = inputs.wide_pings_mercator(spark, sf_dir).select("x", "y")
    return raster.assemble_tiles(raster.heat_pixels(pings, P.MIN_ZOOM, P.MAX_ZOOM, P.HEAT_BLUR, P.HEAT_CAP, _box_spans(spark)))


def road_tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-left tile of the road envelope at zooms 0..MAX_ZOOM."""
    return raster.tile_offsets(_road_env(spark, sf_dir), P.MAX_ZOOM)


def road_tile_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile span and aligned bounds of the road envelope per zoom."""
    return _rounded(raster.tile_spans(_road_env(spark, sf_dir), P.MIN_ZOOM, P.MAX_ZOOM))


def wide_road_tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-left tile of the envelope of the wide roads (one per supplier) at zooms 0..MAX_ZOOM."""
    return raster.tile_offsets(_line_env(inputs.wide_roads_mercator(spark, sf_dir)), P.MAX_ZOOM)


def wide_road_tile_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile span and aligned bounds of the envelope of the wide roads per zoom."""
    return _rounded(raster.tile_spans(_line_env(inputs.wide_roads_mercator(spark, sf_dir)), P.MIN_ZOOM, P.MAX_ZOOM))


def wide_lines_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide roads (one per supplier) wholly inside the Beijing box; others cross its edge or lie beyond."""
    return raster.lines_in_box(inputs.wide_roads_mercator(spark, sf_dir), P.BEIJING_BOX_3857).select("feature_id")


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road pixels per zoom inside the road envelope's tile span."""
    spans = raster.tile_spans(_road_env(spark, sf_dir), P.MIN_ZOOM, P.MAX_ZOOM)
    return raster.line_pixels(inputs.roads_mercator(spark, sf_dir), spans, P.MIN_ZOOM, P.MAX_ZOOM)


def line_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty line tiles per zoom."""
    pix = line_pixels(spark, sf_dir).withColumn("intensity", F.lit(1.0))
    return raster.assemble_tiles(pix, weight="hits")


def line_tiles_beijing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line tiles restricted to the Beijing box: only roads wholly inside it are
    drawn, on the box's tile span."""
    roads = raster.lines_in_box(inputs.roads_mercator(spark, sf_dir), P.BEIJING_BOX_3857)
    spans = raster.tile_spans(raster.box_envelope(spark, P.BEIJING_BOX_3857), P.MIN_ZOOM, P.MAX_ZOOM)
    pix = raster.line_pixels(roads, spans, P.MIN_ZOOM, P.MAX_ZOOM).withColumn("intensity", F.lit(1.0))
    return raster.assemble_tiles(pix, weight="hits")


def wide_line_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty tiles per zoom of the wide roads (one per supplier)."""
    roads = inputs.wide_roads_mercator(spark, sf_dir)
    spans = raster.tile_spans(_line_env(roads), P.MIN_ZOOM, P.MAX_ZOOM)
    return _line_tiles(raster.line_pixels(roads, spans, P.MIN_ZOOM, P.MAX_ZOOM))


def wide_line_tiles_beijing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the wide roads on the Beijing box's tile span: roads that cross its edge are
    clipped to it, those beyond make no pixels."""
    return _line_tiles(raster.line_pixels(inputs.wide_roads_mercator(spark, sf_dir), _box_spans(spark), P.MIN_ZOOM, P.MAX_ZOOM))


def _line_tiles(pixels: DataFrame) -> DataFrame:
    return raster.assemble_tiles(pixels.withColumn("intensity", F.lit(1.0)), weight="hits")


def lines_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads wholly inside the Beijing box (Mercator)."""
    return raster.lines_in_box(inputs.roads_mercator(spark, sf_dir), P.BEIJING_BOX_3857).select("feature_id")

