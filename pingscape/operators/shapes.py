"""DataFrame-level helpers over shape tables `(feature_id, kind, parts, ...)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from .buffers import circle_ring


def decode_wkt(df: DataFrame, col: str = "geometry", kind: str = "kind", parts: str = "parts") -> DataFrame:
    """Add `kind` and `parts` decoded from a WKT text column; rows whose text
    does not decode are left out (`undecoded_wkt` returns those)."""
    out = df.withColumns({kind: geom.wkt_kind(col), parts: geom.wkt_parts(col)})
    return out.where(F.col(parts).isNotNull())


def undecoded_wkt(df: DataFrame, col: str = "geometry") -> DataFrame:
    """The rows whose text does not decode, with the text as `corrupt_record`."""
    return df.where(geom.wkt_parts(col).isNull()).withColumn("corrupt_record", F.col(col))


def segments(lines: DataFrame) -> DataFrame:
    """One row per segment: `feature_id, seg_idx, x1, y1, x2, y2`."""
    s = lines.select("feature_id", F.posexplode(geom.edges("parts")).alias("seg_idx", "s"))
    return s.select("feature_id", "seg_idx", "s.x1", "s.y1", "s.x2", "s.y2")


def circle_rings(points: DataFrame, radius: float, vertices: int = 32) -> DataFrame:
    """Circle polygons (`kind`, `parts`) of `radius` around every point `(x, y)`."""
    return points.withColumns({"kind": F.lit("POLYGON"), "parts": circle_ring("x", "y", radius, vertices)})


def shape_envelopes(shapes: DataFrame) -> DataFrame:
    """`min_x, min_y, max_x, max_y` of every shape."""
    return shapes.withColumn("env", geom.envelope("parts")).select("*", "env.*").drop("env")


def with_wkt(shapes: DataFrame, decimals: int | None = None, col: str = "wkt") -> DataFrame:
    return shapes.withColumn(col, geom.to_wkt("kind", "parts", decimals))
