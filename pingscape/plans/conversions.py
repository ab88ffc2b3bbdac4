"""Coordinate conversions and shape text over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.sql import register_sql_functions
from ..functions.crs import gcj02_to_wgs84, to_mercator, to_utm50n, wgs84_to_gcj02
from ..sources import fixtures
from . import inputs


def gcj_to_wgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings read as GCJ-02 positions, shifted back to WGS-84 (iterative inverse)."""
    p = gcj02_to_wgs84(fixtures.pings(spark, sf_dir).select("ping_id", "lng", "lat"), "lng", "lat", "wgs_lng", "wgs_lat")
    return p.select("ping_id", F.round("wgs_lng", 8).alias("wgs_lng"), F.round("wgs_lat", 8).alias("wgs_lat"))


def gcj_to_wgs_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same correction by the SQL functions."""
    register_sql_functions(spark)
    p = fixtures.pings(spark, sf_dir).select("ping_id", F.expr("gcj_to_wgs(lng, lat)").alias("w"))
    return p.select("ping_id", F.round("w.lng", 8).alias("wgs_lng"), F.round("w.lat", 8).alias("wgs_lat"))


def wgs_to_gcj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings shifted from WGS-84 to GCJ-02."""
    p = wgs84_to_gcj02(fixtures.pings(spark, sf_dir).select("ping_id", "lng", "lat"), "lng", "lat", "gcj_lng", "gcj_lat")
    return p.select("ping_id", F.round("gcj_lng", 8).alias("gcj_lng"), F.round("gcj_lat", 8).alias("gcj_lat"))


def utm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings in UTM zone 50N metres (millimetres kept)."""
    p = to_utm50n(fixtures.pings(spark, sf_dir).select("ping_id", "lng", "lat"))
    return p.select("ping_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named points (suppliers) projected to Mercator, keeping the name; ordered
    by their text form."""
    p = to_mercator(fixtures.pois(spark, sf_dir, with_name=True))
    out = p.select("feature_id", "name", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"),
                   F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
    return out.orderBy("name", "feature_id")


def wkt_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads and zones written as WKT text (Mercator), decoded back, and
    measured: vertex count, coordinate sums, length or area."""
    roads = inputs.roads_mercator(spark, sf_dir).withColumn("feature_id", F.col("feature_id"))
    zones = inputs.zones_mercator(spark, sf_dir).withColumn("feature_id", F.col("feature_id") + 100)
    shapes = roads.unionByName(zones)
    text = shapes.select("feature_id", geom.to_wkt("kind", "parts").alias("wkt"))
    dec = text.select("feature_id", geom.wkt_kind("wkt").alias("kind"), geom.wkt_parts("wkt").alias("parts"))
    v = geom.vertices("parts")
    measure = F.when(F.col("kind") == "POLYGON", geom.polygon_area("parts")).otherwise(geom.line_length("parts"))
    return dec.select(
        "feature_id",
        "kind",
        F.size(v).alias("n_vertices"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, p: a + p["x"]), 3).alias("sum_x"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, p: a + p["y"]), 3).alias("sum_y"),
        F.round(measure, 3).alias("measure"),
    )
