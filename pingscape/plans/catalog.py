"""Registry of the named analyses: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import colocation as C
from . import conversions as V
from . import tilemaps as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    # step 1: distance join per POI and day
    "poi_visits_by_day": C.poi_visits_by_day,
    # step 2: time filters and date parts
    "pings_in_range": C.pings_in_range,
    "winter_pings": C.winter_pings,
    "morning_pings_by_day": C.morning_pings_by_day,
    "study_area_pings_by_day": C.study_area_pings_by_day,
    # step 3: window statistics and rankings
    "poi_window_stats": C.poi_window_stats,
    "matched_windows": C.matched_windows,
    "top_poi_by_density": C.top_poi_by_density,
    "top_poi_by_count": C.top_poi_by_count,
    # step 4: double join
    "pois_near_cases": C.pois_near_cases,
    "case_exposure_by_day": C.case_exposure_by_day,
    # step 5: polygons
    "zone_counts_by_day": C.zone_counts_by_day,
    "zone_totals": C.zone_totals,
    "labeled_zone_hour8": C.labeled_zone_hour8,
    # step 6: lines
    "road_pings": C.road_pings,
    "road_visits_by_day": C.road_visits_by_day,
    "road_visits_unordered": C.road_visits_unordered,
    "line_segments": C.line_segments,
    "road_wkt": C.road_wkt,
    "road_window_stats": C.road_window_stats,
    "top_road_by_density": C.top_road_by_density,
    # step 7: hourly grid, envelope
    "hourly_grid_counts": C.hourly_grid_counts,
    "ping_envelope": C.ping_envelope,
    # step 8: tile maths and pyramids
    "tile_of_point": T.tile_of_point,
    "tile_corners": T.tile_corners,
    "tile_offsets": T.tile_offsets,
    "tile_spans": T.tile_spans,
    "heat_pixels": T.heat_pixels,
    "heat_tiles": T.heat_tiles,
    "heat_tiles_beijing": T.heat_tiles_beijing,
    "line_pixels": T.line_pixels,
    "line_tiles": T.line_tiles,
    "line_tiles_beijing": T.line_tiles_beijing,
    "lines_in_box": T.lines_in_box,
    # step 9: coordinate conversions; shapes as text
    "gcj_to_wgs": V.gcj_to_wgs,
    "wgs_to_gcj": V.wgs_to_gcj,
    "utm_points": V.utm_points,
    "projected_points": V.projected_points,
    "wkt_decode": V.wkt_decode,
    # shapes with holes and members, shared text ids, windows as text, wide inputs
    "shape_measures": C.shape_measures,
    "ring_nesting": C.ring_nesting,
    "block_totals": C.block_totals,
    "road_visits_by_text_id": C.road_visits_by_text_id,
    "poi_circles": C.poi_circles,
    "segment_capsules": C.segment_capsules,
    "wide_segment_capsules": C.wide_segment_capsules,
    "road_buffers": C.road_buffers,
    "road_visits_sql": C.road_visits_sql,
    "wide_winter_pings": C.wide_winter_pings,
    "wide_hourly_grid_counts": C.wide_hourly_grid_counts,
    "wide_heat_tiles": T.wide_heat_tiles,
    "wide_heat_tiles_beijing": T.wide_heat_tiles_beijing,
    "wide_lines_in_box": T.wide_lines_in_box,
    "wide_line_tiles": T.wide_line_tiles,
    "wide_line_tiles_beijing": T.wide_line_tiles_beijing,
    "heat_pixels_gcj": T.heat_pixels_gcj,
    "tile_offsets_gcj": T.tile_offsets_gcj,
    "road_tile_offsets": T.road_tile_offsets,
    "road_tile_spans": T.road_tile_spans,
    "wide_road_tile_offsets": T.wide_road_tile_offsets,
    "wide_road_tile_spans": T.wide_road_tile_spans,
    "gcj_to_wgs_sql": V.gcj_to_wgs_sql,
}

# the flagship analysis (driver smoke check)
FLAGSHIP = "poi_visits_by_day"
