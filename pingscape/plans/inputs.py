"""Projected inputs shared by the analyses (all lazy DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import gcj02_to_wgs84, to_mercator, to_utm50n
from ..sources import fixtures


def pings_mercator(spark: SparkSession, sf_dir: str, window: tuple[int, int] | None = None) -> DataFrame:
    """`(ping_id, user_id, sys_time, lng, lat, x, y)` in Web-Mercator metres.

    `window` (epoch ms) only prunes the scan; callers still apply the exact bound.
    """
    return to_mercator(fixtures.pings(spark, sf_dir, window))


def pings_utm(spark: SparkSession, sf_dir: str, window: tuple[int, int] | None = None) -> DataFrame:
    """Pings in UTM 50N metres."""
    return to_utm50n(fixtures.pings(spark, sf_dir, window))


def pois_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_mercator(fixtures.pois(spark, sf_dir)).select("feature_id", "x", "y")


def cases_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_mercator(fixtures.cases(spark, sf_dir)).select("case_id", "case_date", "x", "y")


def roads_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road lines as planar Mercator shapes (as a 3857 shapefile would hold them)."""
    return fixtures.project_parts(fixtures.roads_lnglat(spark, sf_dir), "mercator")


def zones_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled zone polygons in Mercator metres."""
    return fixtures.project_parts(fixtures.zones_lnglat(spark, sf_dir), "mercator")


def zones_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fishnet zone polygons in UTM 50N metres."""
    return fixtures.project_parts(fixtures.zones_lnglat(spark, sf_dir), "utm50n")


def only(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c) for c in cols])


def pings_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings read as GCJ-02 positions, corrected and projected to Mercator."""
    p = gcj02_to_wgs84(fixtures.pings(spark, sf_dir).select("ping_id", "lng", "lat"), "lng", "lat", "wgs_lng", "wgs_lat")
    return to_mercator(p, "wgs_lng", "wgs_lat").select("ping_id", "x", "y")


def wide_pings_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_mercator(fixtures.wide_pings(spark, sf_dir))


def wide_roads_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.project_parts(fixtures.wide_roads_lnglat(spark, sf_dir), "mercator")


def blocks_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.project_parts(fixtures.blocks_lnglat(spark, sf_dir), "mercator")
