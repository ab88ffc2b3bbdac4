"""Brute-force DuckDB SQL for every registered analysis.

The oracle never uses grid cells: joins are plain cross products filtered by
the exact predicate, so a bug in the cell logic cannot hide in both engines.
Fixture and projection formulas use the same text and evaluation order as the
Spark column expressions, with every literal written `CAST(... AS DOUBLE)`
(a bare `0.3` is a decimal in both engines).  Integer results are cast to
BIGINT / INTEGER to match Spark's types.
"""

from __future__ import annotations

import math

from ..functions.crs import utm_sql_text
from ..functions.geom import CROSSING_SQL, ON_EDGE_SQL, segment_distance_sql
from ..functions.tiles import EQUATOR
from ..functions.timefn import (
    MS_PER_DAY,
    MS_PER_HOUR,
    date_bounds,
    day_slices,
    hour_slices,
    second_bounds,
)
from . import params as P


def D(v: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({float(v)!r} AS DOUBLE)"


OFF = P.OFFSET_MS
R = D(6378137.0)


def mx(lng: str) -> str:
    return f"radians({lng})*{R}"


def my(lat: str) -> str:
    return f"ln(tan(pi()/4 + radians({lat})/2))*{R}"


def day_sql(ms: str) -> str:
    return f"(DATE '1970-01-01' + CAST((({ms}) + {OFF}) // {MS_PER_DAY} AS INTEGER))"


def hour_of_day_sql(ms: str) -> str:
    return f"CAST(((({ms}) + {OFF}) % {MS_PER_DAY}) // {MS_PER_HOUR} AS INTEGER)"


def dist_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(({x1}-{x2})*({x1}-{x2})+({y1}-{y2})*({y1}-{y2}))"


PINGS = f"""pings AS (
  SELECT event_id AS ping_id, user_id, epoch_us(ts)//1000 AS sys_time,
    {D(116.20)} + CAST((event_id*7919 + user_id*104729) % 100003 AS DOUBLE)/100003*{D(0.30)} AS lng,
    {D(39.80)} + CAST((event_id*15485863 + user_id*32452843) % 100019 AS DOUBLE)/100019*{D(0.25)} AS lat
  FROM events)"""

PINGS_M = f"""pm AS (SELECT ping_id, sys_time, lng, lat, {mx('lng')} AS x, {my('lat')} AS y FROM pings)"""

POIS_M = f"""poim AS (
  SELECT s_suppkey AS feature_id,
    {mx(f"({D(116.20)} + CAST((s_suppkey*611953) % 10007 AS DOUBLE)/10007*{D(0.30)})")} AS x,
    {my(f"({D(39.80)} + CAST((s_suppkey*746773) % 10009 AS DOUBLE)/10009*{D(0.25)})")} AS y
  FROM supplier)"""

CASES_M = f"""casem AS (
  SELECT c_custkey AS case_id, DATE '2024-01-01' + CAST((c_custkey*7) % 30 AS INTEGER) AS case_date,
    {mx(f"({D(116.20)} + CAST((c_custkey*49979687) % 10037 AS DOUBLE)/10037*{D(0.30)})")} AS x,
    {my(f"({D(39.80)} + CAST((c_custkey*86028121) % 10039 AS DOUBLE)/10039*{D(0.25)})")} AS y
  FROM customer)"""

# road vertices (k = 0..3) in degrees, and consecutive-vertex segments in Mercator
ROADS_M = f"""roadv AS (
  SELECT CAST(n_nationkey AS BIGINT) AS feature_id, r.range AS k,
    {D(116.22)} + CAST((CAST(n_nationkey AS BIGINT)*37) % 25 AS DOUBLE)/{D(25.0)}*{D(0.22)} + r.range*{D(0.008)} AS lng,
    {D(39.82)} + CAST((CAST(n_nationkey AS BIGINT)*11) % 25 AS DOUBLE)/{D(25.0)}*{D(0.18)}
      + CAST((CAST(n_nationkey AS BIGINT)*(r.range+3)) % 7 AS DOUBLE)*{D(0.004)} AS lat
  FROM nation, range(4) r),
roadm AS (SELECT feature_id, k, {mx('lng')} AS x, {my('lat')} AS y FROM roadv),
segs AS (
  SELECT a.feature_id, a.k AS seg_idx, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM roadm a JOIN roadm b ON a.feature_id = b.feature_id AND b.k = a.k + 1)"""

# hexagon vertices (k = 0..5) in degrees; edges k -> (k+1) % 6
ZONES = f"""zonev AS (
  SELECT CAST(n_nationkey AS BIGINT) AS feature_id, r.range AS k,
    {D(116.35)} + CAST((CAST(n_nationkey AS BIGINT)*37)%25 AS DOUBLE)/{D(25.0)}*{D(0.2)} - {D(0.1)}
      + {D(0.02)}*cos(CAST(r.range AS DOUBLE)*pi()/{D(3.0)}) AS lng,
    {D(39.92)} + CAST((CAST(n_nationkey AS BIGINT)*11)%25 AS DOUBLE)/{D(25.0)}*{D(0.16)} - {D(0.08)}
      + {D(0.015)}*sin(CAST(r.range AS DOUBLE)*pi()/{D(3.0)}) AS lat
  FROM nation, range(6) r)"""


def zone_edges(system: str) -> str:
    if system == "mercator":
        px, py = mx("lng"), my("lat")
    else:
        px, py = utm_sql_text("lng", "lat")
    return f"""zonep AS (SELECT feature_id, k, {px} AS x, {py} AS y FROM zonev),
zedges AS (
  SELECT a.feature_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM zonep a JOIN zonep b ON a.feature_id = b.feature_id AND b.k = (a.k + 1) % 6)"""


def pip_pairs(points: str) -> str:
    """(point row, zone) pairs strictly inside: odd crossings, not on an edge."""
    cross = CROSSING_SQL.format(px="p.x", py="p.y", x1="e.x1", y1="e.y1", x2="e.x2", y2="e.y2")
    on = ON_EDGE_SQL.format(px="p.x", py="p.y", x1="e.x1", y1="e.y1", x2="e.x2", y2="e.y2")
    return f"""inside AS (
  SELECT p.ping_id, e.feature_id
  FROM {points} p, zedges e
  GROUP BY p.ping_id, e.feature_id
  HAVING SUM({cross}) % 2 = 1 AND NOT bool_or({on}))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# the queries
# ---------------------------------------------------------------------------
def poi_visits_by_day() -> str:
    lo, hi = date_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(PINGS, PINGS_M, POIS_M) + f"""
SELECT poim.feature_id, {day_sql('pm.sys_time')} AS day, COUNT(*) AS join_count
FROM pm, poim
WHERE pm.sys_time > {lo} AND pm.sys_time < {hi}
  AND {dist_sql('pm.x', 'pm.y', 'poim.x', 'poim.y')} <= {D(P.POI_RADIUS)}
GROUP BY 1, 2 ORDER BY day, feature_id"""


def _windows() -> str:
    return f"""win AS (
  SELECT poim.feature_id, COUNT(*) AS n, COUNT(DISTINCT (pm.x, pm.y)) AS n_distinct
  FROM pm, poim
  WHERE {dist_sql('pm.x', 'pm.y', 'poim.x', 'poim.y')} < {D(P.POI_RADIUS)}
  GROUP BY 1),
wstat AS (
  SELECT feature_id, n, n_distinct, {D(P.POI_RADIUS)} * {D(P.POI_RADIUS)} * pi() AS area,
    n_distinct / ({D(P.POI_RADIUS)} * {D(P.POI_RADIUS)} * pi()) AS density
  FROM win)"""


def poi_window_stats() -> str:
    return _with(PINGS, PINGS_M, POIS_M, _windows()) + "SELECT * FROM wstat ORDER BY density DESC, feature_id"


def matched_windows() -> str:
    return _with(PINGS, PINGS_M, POIS_M, _windows()) + "SELECT COUNT(*) AS n_windows FROM wstat"


def _circles(vertices: int = 32) -> str:
    """Circle rings of the POIs: vertex k at angle 2 pi k / vertices, the last on the first."""
    step = D(2.0 * math.pi / vertices)
    return f"""cv AS (
  SELECT feature_id, k.range AS k, x + {D(P.POI_RADIUS)} * cos(CAST(k.range % {vertices} AS DOUBLE) * {step}) AS vx,
    y + {D(P.POI_RADIUS)} * sin(CAST(k.range % {vertices} AS DOUBLE) * {step}) AS vy
  FROM poim, range({vertices + 1}) k),
cw AS (SELECT feature_id, 'POLYGON ((' || string_agg(printf('%.3f %.3f', vx, vy), ', ' ORDER BY k) || '))' AS wkt, COUNT(*) AS n FROM cv GROUP BY 1)"""


def top_poi_by_density() -> str:
    return _with(PINGS, PINGS_M, POIS_M, _windows(), _circles()) + (
        f"SELECT feature_id, wkt, n_distinct, density FROM wstat JOIN cw USING (feature_id) ORDER BY density DESC, feature_id LIMIT {P.FIRST_X}"
    )


def top_poi_by_count() -> str:
    return _with(PINGS, PINGS_M, POIS_M, _windows(), _circles()) + (
        f"SELECT feature_id, wkt, n_distinct FROM wstat JOIN cw USING (feature_id) ORDER BY n_distinct DESC, feature_id LIMIT {P.FIRST_X}"
    )


def poi_circles() -> str:
    return _with(POIS_M, _circles()) + f"""
SELECT cw.feature_id, wkt, CAST(n AS INTEGER) AS n_vertices, round({D(32 * math.sin(2 * math.pi / 32) / 2)} * {D(P.POI_RADIUS)} * {D(P.POI_RADIUS)}, 3) AS area
FROM cw"""


def _poi_case_pairs() -> str:
    return f"""pc AS (
  SELECT poim.feature_id, poim.x AS px, poim.y AS py, casem.case_id, casem.case_date
  FROM poim, casem
  WHERE {dist_sql('poim.x', 'poim.y', 'casem.x', 'casem.y')} <= {D(P.CASE_RADIUS)})"""


def pois_near_cases() -> str:
    return _with(POIS_M, CASES_M, _poi_case_pairs()) + "SELECT feature_id, case_id, case_date FROM pc"


def _study_area_sql(x: str, y: str) -> str:
    from ..operators.filters import STUDY_AREA

    lng0, lat0, lng1, lat1 = STUDY_AREA
    return (
        f"{x} > {mx(D(lng0))} AND {x} < {mx(D(lng1))} AND {y} > {my(D(lat0))} AND {y} < {my(D(lat1))}"
    )


def case_exposure_by_day() -> str:
    lo, hi = date_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    span = P.EXPOSURE_DAYS * MS_PER_DAY
    case_ms = f"(CAST(date_diff('day', DATE '1970-01-01', pc.case_date) AS BIGINT) * {MS_PER_DAY} - {OFF})"
    return _with(PINGS, PINGS_M, POIS_M, CASES_M, _poi_case_pairs()) + f"""
SELECT pc.feature_id, {day_sql('pm.sys_time')} AS day, COUNT(*) AS join_count
FROM pm, pc
WHERE pm.sys_time > {lo} AND pm.sys_time < {hi}
  AND {_study_area_sql('pm.x', 'pm.y')}
  AND {dist_sql('pm.x', 'pm.y', 'pc.px', 'pc.py')} <= {D(P.EXPOSURE_RADIUS)}
  AND pm.sys_time >= {case_ms} - {span} AND pm.sys_time <= {case_ms} + {span}
GROUP BY 1, 2 ORDER BY day, feature_id"""


def _pings_utm() -> str:
    ux, uy = utm_sql_text("lng", "lat")
    return f"pu AS (SELECT ping_id, sys_time, {ux} AS x, {uy} AS y FROM pings)"


def zone_counts_by_day() -> str:
    lo, hi = day_slices(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(
        PINGS,
        _pings_utm(),
        f"pf AS (SELECT * FROM pu WHERE sys_time > {lo} AND sys_time < {hi} AND (sys_time + {OFF}) % {MS_PER_DAY} <> 0)",
        ZONES,
        zone_edges("utm"),
        pip_pairs("pf"),
    ) + f"""
SELECT {day_sql('pf.sys_time')} AS day, inside.feature_id, COUNT(*) AS join_count
FROM inside JOIN pf USING (ping_id) GROUP BY 1, 2"""


def zone_totals() -> str:
    lo, hi = second_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(
        PINGS,
        _pings_utm(),
        f"pf AS (SELECT * FROM pu WHERE sys_time > {lo} AND sys_time < {hi})",
        ZONES,
        zone_edges("utm"),
        pip_pairs("pf"),
    ) + """
SELECT inside.feature_id, COUNT(*) AS n, COUNT(DISTINCT (pf.x, pf.y)) AS n_distinct
FROM inside JOIN pf USING (ping_id) GROUP BY 1"""


def labeled_zone_hour8() -> str:
    lo, hi = date_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(
        PINGS,
        PINGS_M,
        f"pf AS (SELECT * FROM pm WHERE sys_time > {lo} AND sys_time < {hi} AND {hour_of_day_sql('sys_time')} = {P.MORNING_HOUR})",
        ZONES,
        zone_edges("mercator"),
        pip_pairs("pf"),
    ) + f"""
SELECT {day_sql('pf.sys_time')} AS day, COUNT(*) AS join_count
FROM inside JOIN pf USING (ping_id) GROUP BY 1 ORDER BY 1"""


def _road_pairs(where: str = "TRUE") -> str:
    d = segment_distance_sql("pm.x", "pm.y", "segs.x1", "segs.y1", "segs.x2", "segs.y2")
    return f"""rp AS (
  SELECT DISTINCT pm.ping_id, pm.sys_time, pm.x, pm.y, segs.feature_id
  FROM pm, segs
  WHERE {where} AND {d} < {D(P.ROAD_RADIUS)})"""


def road_pings() -> str:
    return _with(PINGS, PINGS_M, ROADS_M, _road_pairs()) + """
SELECT feature_id, COUNT(*) AS n, COUNT(DISTINCT (x, y)) AS n_distinct FROM rp GROUP BY 1"""


def road_visits_by_day() -> str:
    lo, hi = second_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(PINGS, PINGS_M, ROADS_M, _road_pairs(f"pm.sys_time > {lo} AND pm.sys_time < {hi}")) + f"""
SELECT feature_id, {day_sql('sys_time')} AS day, COUNT(*) AS join_count FROM rp GROUP BY 1, 2 ORDER BY day, feature_id"""


def road_visits_unordered() -> str:
    lo, hi = second_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(PINGS, PINGS_M, ROADS_M, _road_pairs(f"pm.sys_time > {lo} AND pm.sys_time < {hi}")) + f"""
SELECT feature_id, {day_sql('sys_time')} AS day, COUNT(*) AS join_count FROM rp GROUP BY 1, 2"""


def line_segments() -> str:
    r = D(P.ROAD_RADIUS)
    return _with(ROADS_M) + f"""
SELECT feature_id, CAST(seg_idx AS INTEGER) AS seg_idx,
  round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2,
  round({dist_sql('x1', 'y1', 'x2', 'y2')}, 3) AS length,
  round(least(x1, x2) - {r}, 3) AS buf_min_x, round(least(y1, y2) - {r}, 3) AS buf_min_y,
  round(greatest(x1, x2) + {r}, 3) AS buf_max_x, round(greatest(y1, y2) + {r}, 3) AS buf_max_y
FROM segs ORDER BY feature_id, seg_idx"""


def pings_in_range() -> str:
    lo, hi = second_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(PINGS) + f"""
SELECT ping_id, sys_time, {day_sql('sys_time')} AS day FROM pings WHERE sys_time > {lo} AND sys_time < {hi}"""


def winter_pings() -> str:
    ts = f"(TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(sys_time + {OFF}))"
    months = ", ".join(str(m) for m in P.WINTER_MONTHS)
    return _with(PINGS) + f"""
SELECT ping_id, sys_time, strftime({ts}, '%Y-%m-%d %H:%M:%S') AS time_text, CAST(month({ts}) AS INTEGER) AS month
FROM pings WHERE month({ts}) IN ({months})"""


def morning_pings_by_day() -> str:
    lo, hi = date_bounds(P.FROM_TIME, P.TO_TIME, OFF)
    return _with(PINGS) + f"""
SELECT {day_sql('sys_time')} AS day, COUNT(*) AS n_pings FROM pings
WHERE sys_time > {lo} AND sys_time < {hi} AND {hour_of_day_sql('sys_time')} = {P.MORNING_HOUR}
GROUP BY 1"""


def hourly_grid_counts() -> str:
    lo, hi = hour_slices(P.GRID_FROM_TIME, P.GRID_TO_TIME, OFF)
    n = int(math.isqrt(P.NUM_PARTITIONS))
    min_lng, min_lat, max_lng, max_lat = P.GRID_BOX
    w_lng = (max_lng - min_lng) / n
    w_lat = (max_lat - min_lat) / n

    def idx(v: str, a: float, b: float) -> str:
        return f"least({n - 1}, CAST(floor(({v} - {D(a)}) / {D(b - a)} * {n}) AS INTEGER))"

    return _with(PINGS) + f""",
sl AS (SELECT * FROM pings WHERE sys_time > {lo} AND sys_time < {hi} AND (sys_time + {OFF}) % {MS_PER_HOUR} <> 0),
hours AS (SELECT DISTINCT (sys_time + {OFF}) // {MS_PER_HOUR} AS hour FROM sl),
cnt AS (
  SELECT (sys_time + {OFF}) // {MS_PER_HOUR} AS hour, {idx('lng', min_lng, max_lng)} AS cell_i,
    {idx('lat', min_lat, max_lat)} AS cell_j, COUNT(*) AS c
  FROM sl WHERE lng BETWEEN {D(min_lng)} AND {D(max_lng)} AND lat BETWEEN {D(min_lat)} AND {D(max_lat)}
  GROUP BY 1, 2, 3),
grid AS (SELECT hour, CAST(i.range AS INTEGER) AS cell_i, CAST(j.range AS INTEGER) AS cell_j FROM hours, range({n}) i, range({n}) j)
SELECT CAST(TIMESTAMP '1970-01-01 00:00:00' + to_hours(grid.hour) AS TIMESTAMP) AS hour_start, grid.cell_i, grid.cell_j,
  {D(min_lng)} + grid.cell_i * {D(w_lng)} AS min_lng, {D(min_lat)} + grid.cell_j * {D(w_lat)} AS min_lat,
  {D(min_lng)} + (grid.cell_i + 1) * {D(w_lng)} AS max_lng, {D(min_lat)} + (grid.cell_j + 1) * {D(w_lat)} AS max_lat,
  CAST(coalesce(cnt.c, 0) AS BIGINT) AS number_of_records
FROM grid LEFT JOIN cnt USING (hour, cell_i, cell_j)"""


def ping_envelope() -> str:
    return _with(PINGS, PINGS_M) + """
SELECT round(min(x), 3) AS min_x, round(min(y), 3) AS min_y, round(max(x), 3) AS max_x, round(max(y), 3) AS max_y,
  COUNT(*) AS n FROM pm"""


ORACLES = {
    "poi_visits_by_day": poi_visits_by_day,
    "poi_window_stats": poi_window_stats,
    "matched_windows": matched_windows,
    "top_poi_by_density": top_poi_by_density,
    "top_poi_by_count": top_poi_by_count,
    "pois_near_cases": pois_near_cases,
    "case_exposure_by_day": case_exposure_by_day,
    "zone_counts_by_day": zone_counts_by_day,
    "zone_totals": zone_totals,
    "labeled_zone_hour8": labeled_zone_hour8,
    "road_pings": road_pings,
    "road_visits_by_day": road_visits_by_day,
    "road_visits_unordered": road_visits_unordered,
    "line_segments": line_segments,
    "pings_in_range": pings_in_range,
    "winter_pings": winter_pings,
    "morning_pings_by_day": morning_pings_by_day,
    "hourly_grid_counts": hourly_grid_counts,
    "ping_envelope": ping_envelope,
}


def all_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}


# ---------------------------------------------------------------------------
# tiles
# ---------------------------------------------------------------------------
E = D(EQUATOR)
HALF = D(EQUATOR / 2.0)


def _tile(x: str, y: str, z: str) -> tuple[str, str]:
    s = f"pow({D(2.0)}, {z})"
    return (
        f"CAST(trunc(({x} + {HALF}) / {E} * {s}) AS INTEGER)",
        f"CAST(trunc(({HALF} - {y}) / {E} * {s}) AS INTEGER)",
    )


def _pixel(x: str, y: str, z: str) -> tuple[str, str]:
    s = f"(pow({D(2.0)}, {z}) * {D(256.0)})"
    return (
        f"CAST(floor(({x} + {HALF}) / {E} * {s}) AS BIGINT)",
        f"CAST(floor(({HALF} - {y}) / {E} * {s}) AS BIGINT)",
    )


def tile_of_point() -> str:
    s = f"pow({D(2.0)}, 18)"
    mtx, mty = _tile("x", "y", "18")
    return _with(PINGS, PINGS_M) + f"""
SELECT ping_id,
  CAST(trunc((lng + {D(180.0)}) / {D(360.0)} * {s}) AS INTEGER) AS tx,
  CAST(trunc(({D(1.0)} - ln(tan(radians(lat)) + {D(1.0)} / cos(radians(lat))) / pi()) / {D(2.0)} * {s}) AS INTEGER) AS ty,
  {mtx} AS mtx, {mty} AS mty
FROM pm"""


def tile_corners() -> str:
    z = P.TILE_ZOOM
    tx, ty = _tile("x", "y", str(z))
    s = f"pow({D(2.0)}, {z})"
    return _with(PINGS, PINGS_M, f"t AS (SELECT DISTINCT {tx} AS tx, {ty} AS ty FROM pm)") + f"""
SELECT {z} AS z, tx, ty,
  round(CAST(tx AS DOUBLE) * {E} / {s} - {HALF}, 3) AS corner_x,
  round({HALF} - CAST(ty AS DOUBLE) * {E} / {s}, 3) AS corner_y,
  round(degrees(atan(sinh(pi() * ({D(1.0)} - {D(2.0)} * CAST(ty AS DOUBLE) / {s})))), 9) AS corner_lat,
  round(CAST(tx AS DOUBLE) / {s} * {D(360.0)} - {D(180.0)}, 9) AS corner_lng,
  'https://tile.openstreetmap.org/' || {z} || '/' || tx || '/' || ty || '.png' AS url
FROM t"""


def _env_pings() -> str:
    return "env AS (SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM pm)"


def _env_roads() -> str:
    return "env AS (SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM roadm)"


def _spans(lo: int, hi: int) -> str:
    tx0, ty0 = _tile("min_x", "max_y", "z")
    tx1, ty1 = _tile("max_x", "min_y", "z")
    s = f"pow({D(2.0)}, z)"
    return f"""sp0 AS (SELECT CAST(zz.range AS INTEGER) AS z, {tx0} AS tx0, {ty0} AS ty0, {tx1} AS tx1, {ty1} AS ty1
  FROM env, range({lo}, {hi + 1}) zz),
spans AS (SELECT z, tx0, ty0, tx1, ty1, tx1 - tx0 + 1 AS scale_x, ty1 - ty0 + 1 AS scale_y,
  CAST(tx0 AS DOUBLE) * {E} / {s} - {HALF} AS min_x,
  {HALF} - CAST(ty1 + 1 AS DOUBLE) * {E} / {s} AS min_y,
  CAST(tx1 + 1 AS DOUBLE) * {E} / {s} - {HALF} AS max_x,
  {HALF} - CAST(ty0 AS DOUBLE) * {E} / {s} AS max_y
  FROM sp0)"""


def tile_offsets() -> str:
    tx, ty = _tile("min_x", "max_y", "z")
    return _with(PINGS, PINGS_M, _env_pings()) + f"""
SELECT z, {tx} AS tx, {ty} AS ty FROM (SELECT env.*, CAST(zz.range AS INTEGER) AS z FROM env, range(0, {P.MAX_ZOOM + 1}) zz)"""


def tile_spans() -> str:
    return _with(PINGS, PINGS_M, _env_pings(), _spans(P.MIN_ZOOM, P.MAX_ZOOM)) + """
SELECT z, tx0, ty0, tx1, ty1, scale_x, scale_y, round(min_x, 3) AS min_x, round(min_y, 3) AS min_y,
  round(max_x, 3) AS max_x, round(max_y, 3) AS max_y FROM spans"""


def _inside(a: str = "") -> str:
    p = f"{a}." if a else ""
    return (
        f"{p}px >= spans.tx0 * 256 AND {p}px < (spans.tx1 + 1) * 256 AND "
        f"{p}py >= spans.ty0 * 256 AND {p}py < (spans.ty1 + 1) * 256"
    )


def _heat(envelope_cte: str) -> str:
    px, py = _pixel("x", "y", "z")
    b = P.HEAT_BLUR
    area = float((2 * b + 1) ** 2)
    return _with(PINGS, PINGS_M, envelope_cte, _spans(P.MIN_ZOOM, P.MAX_ZOOM)) + f""",
pz AS (SELECT CAST(zz.range AS INTEGER) AS z, pm.x, pm.y FROM pm, range({P.MIN_ZOOM}, {P.MAX_ZOOM + 1}) zz),
cnt AS (SELECT z, {px} AS px, {py} AS py, COUNT(*) AS n FROM pz GROUP BY 1, 2, 3),
c2 AS (SELECT cnt.* FROM cnt JOIN spans USING (z) WHERE {_inside('cnt')}),
bl AS (SELECT z, px + a.range AS px, py + b.range AS py, CAST(SUM(n) AS BIGINT) AS n_sum
  FROM c2, range({-b}, {b + 1}) a, range({-b}, {b + 1}) b GROUP BY 1, 2, 3),
heat AS (SELECT bl.z, bl.px, bl.py, bl.n_sum, CAST(bl.n_sum AS DOUBLE) / {D(area)} AS value,
  least(CAST(bl.n_sum AS DOUBLE) / {D(area)}, {D(P.HEAT_CAP)}) / {D(P.HEAT_CAP)} AS intensity
  FROM bl JOIN spans USING (z) WHERE {_inside('bl')})
"""


def heat_pixels() -> str:
    return _heat(_env_pings()) + "SELECT * FROM heat"


def _tiles_of(src: str, weight: str, value: str) -> str:
    return f"""SELECT z, CAST(floor(px / 256) AS INTEGER) AS tx, CAST(floor(py / 256) AS INTEGER) AS ty,
  COUNT(*) AS n_pixels, CAST(SUM({weight}) AS BIGINT) AS total, max({value}) AS peak
FROM {src} GROUP BY 1, 2, 3"""


def heat_tiles() -> str:
    return _heat(_env_pings()) + _tiles_of("heat", "n_sum", "intensity")


def heat_tiles_beijing() -> str:
    x0, y0, x1, y1 = P.BEIJING_BOX_3857
    env = f"env AS (SELECT {D(x0)} AS min_x, {D(y0)} AS min_y, {D(x1)} AS max_x, {D(y1)} AS max_y)"
    return _heat(env) + _tiles_of("heat", "n_sum", "intensity")


def _line_pix(env_cte: str | None = None, road_filter: str = "TRUE") -> str:
    s = f"(pow({D(2.0)}, z) * {D(256.0)})"
    return _with(ROADS_M, env_cte or _env_roads(), _spans(P.MIN_ZOOM, P.MAX_ZOOM)) + f""",
sz AS (SELECT segs.feature_id, CAST(zz.range AS INTEGER) AS z,
  (x1 + {HALF}) / {E} * {s} AS fx1, ({HALF} - y1) / {E} * {s} AS fy1,
  (x2 + {HALF}) / {E} * {s} AS fx2, ({HALF} - y2) / {E} * {s} AS fy2
  FROM segs, range({P.MIN_ZOOM}, {P.MAX_ZOOM + 1}) zz WHERE {road_filter}),
st AS (SELECT *, CAST(greatest(abs(floor(fx2) - floor(fx1)), abs(floor(fy2) - floor(fy1))) AS INTEGER) AS steps FROM sz),
pts AS (SELECT z,
  CAST(floor(fx1 + (fx2 - fx1) * t / CAST(greatest(steps, 1) AS DOUBLE)) AS BIGINT) AS px,
  CAST(floor(fy1 + (fy2 - fy1) * t / CAST(greatest(steps, 1) AS DOUBLE)) AS BIGINT) AS py
  FROM st CROSS JOIN LATERAL (SELECT unnest(range(0, st.steps + 1)) AS t)),
lp AS (SELECT pts.z, pts.px, pts.py, COUNT(*) AS hits FROM pts JOIN spans USING (z) WHERE {_inside('pts')} GROUP BY 1, 2, 3)
"""


def line_pixels() -> str:
    return _line_pix() + "SELECT * FROM lp"


def line_tiles() -> str:
    return _line_pix() + _tiles_of("(SELECT *, CAST(1.0 AS DOUBLE) AS intensity FROM lp)", "hits", "intensity")


def _in_box_ids() -> str:
    x0, y0, x1, y1 = (D(v) for v in P.BEIJING_BOX_3857)
    return f"""SELECT feature_id FROM roadm GROUP BY feature_id
HAVING bool_and(x >= {x0} AND x <= {x1} AND y >= {y0} AND y <= {y1})
INTERSECT
SELECT feature_id FROM segs
WHERE (x1 + x2) / {D(2.0)} > {x0} AND (x1 + x2) / {D(2.0)} < {x1}
  AND (y1 + y2) / {D(2.0)} > {y0} AND (y1 + y2) / {D(2.0)} < {y1}"""


def lines_in_box() -> str:
    return _with(ROADS_M) + _in_box_ids()


def line_tiles_beijing() -> str:
    x0, y0, x1, y1 = P.BEIJING_BOX_3857
    env = f"env AS (SELECT {D(x0)} AS min_x, {D(y0)} AS min_y, {D(x1)} AS max_x, {D(y1)} AS max_y)"
    body = _line_pix(env, f"segs.feature_id IN ({_in_box_ids()})")
    return body + _tiles_of("(SELECT *, CAST(1.0 AS DOUBLE) AS intensity FROM lp)", "hits", "intensity")


# ---------------------------------------------------------------------------
# coordinate conversions
# ---------------------------------------------------------------------------
def _gcj_delta(lng: str, lat: str) -> tuple[str, str]:
    from ..functions.crs import gcj_delta_sql

    return gcj_delta_sql(lng, lat)


def wgs_to_gcj() -> str:
    dl, dt = _gcj_delta("lng", "lat")
    return _with(PINGS) + f"SELECT ping_id, round(lng + {dl}, 8) AS gcj_lng, round(lat + {dt}, 8) AS gcj_lat FROM pings"


def gcj_to_wgs() -> str:
    from ..functions.crs import GCJ_MAX_ROUNDS, GCJ_TOLERANCE

    tol = D(GCJ_TOLERANCE)
    dl, dt = _gcj_delta("lng", "lat")
    ctes = [
        PINGS,
        f"""r0 AS (SELECT ping_id, lng, lat, lng - {dl} AS wl, lat - {dt} AS wt,
  (abs(lng) <= {tol} AND abs(lat) <= {tol}) AS done FROM pings)""",
    ]
    for k in range(1, GCJ_MAX_ROUNDS):
        dl, dt = _gcj_delta("wl", "wt")
        ctes.append(
            f"""d{k} AS (SELECT *, {dl} AS dl, {dt} AS dt FROM r{k - 1}),
r{k} AS (SELECT ping_id, lng, lat,
  CASE WHEN done THEN wl ELSE lng - dl END AS wl,
  CASE WHEN done THEN wt ELSE lat - dt END AS wt,
  done OR (abs((lng - dl) - wl) <= {tol} AND abs((lat - dt) - wt) <= {tol}) AS done
  FROM d{k})"""
        )
    last = GCJ_MAX_ROUNDS - 1
    return _with(*ctes) + f"SELECT ping_id, round(wl, 8) AS wgs_lng, round(wt, 8) AS wgs_lat FROM r{last}"


def utm_points() -> str:
    ux, uy = utm_sql_text("lng", "lat")
    return _with(PINGS) + f"SELECT ping_id, round({ux}, 3) AS x, round({uy}, 3) AS y FROM pings"


def projected_points() -> str:
    lng = f"({D(116.20)} + CAST((s_suppkey*611953) % 10007 AS DOUBLE)/10007*{D(0.30)})"
    lat = f"({D(39.80)} + CAST((s_suppkey*746773) % 10009 AS DOUBLE)/10009*{D(0.25)})"
    return f"""SELECT s_suppkey AS feature_id, s_name AS name, round({lng}, 9) AS lng, round({lat}, 9) AS lat,
  round({mx(lng)}, 3) AS x, round({my(lat)}, 3) AS y FROM supplier ORDER BY name, feature_id"""


def wkt_decode() -> str:
    zone_m = zone_edges("mercator")
    return _with(ROADS_M, ZONES, zone_m) + f"""
SELECT feature_id, 'LINESTRING' AS kind, CAST(COUNT(*) AS INTEGER) AS n_vertices, round(SUM(x), 3) AS sum_x,
  round(SUM(y), 3) AS sum_y,
  round((SELECT SUM({dist_sql('s.x1', 's.y1', 's.x2', 's.y2')}) FROM segs s WHERE s.feature_id = roadm.feature_id), 3) AS measure
FROM roadm GROUP BY feature_id
UNION ALL
SELECT feature_id + 100 AS feature_id, 'POLYGON' AS kind, CAST(COUNT(*) + 1 AS INTEGER) AS n_vertices,
  round(SUM(x) + arg_min(x, k), 3) AS sum_x, round(SUM(y) + arg_min(y, k), 3) AS sum_y,
  round(abs((SELECT SUM((e.x1 - f.x) * (e.y2 - f.y) - (e.x2 - f.x) * (e.y1 - f.y))
    FROM zedges e JOIN zonep f ON f.feature_id = e.feature_id AND f.k = 0
    WHERE e.feature_id = zonep.feature_id)) / {D(2.0)}, 3) AS measure
FROM zonep GROUP BY feature_id"""


ORACLES.update(
    {
        "tile_of_point": tile_of_point,
        "tile_corners": tile_corners,
        "tile_offsets": tile_offsets,
        "tile_spans": tile_spans,
        "heat_pixels": heat_pixels,
        "heat_tiles": heat_tiles,
        "heat_tiles_beijing": heat_tiles_beijing,
        "line_pixels": line_pixels,
        "line_tiles": line_tiles,
        "lines_in_box": lines_in_box,
        "line_tiles_beijing": line_tiles_beijing,
        "gcj_to_wgs": gcj_to_wgs,
        "wgs_to_gcj": wgs_to_gcj,
        "utm_points": utm_points,
        "projected_points": projected_points,
        "wkt_decode": wkt_decode,
    }
)


def _road_boundary(r: float, vertices: int = 32) -> str:
    """CTEs `bpiece` (feature_id, area, arc, n_vertices, chord): the boundary of every road's
    buffer by brute force.  Every circle around a vertex and every parallel of a segment is
    cut at all its crossings with the road's other circles and parallels; a part counts where
    its middle lies outside every capsule of the road.  Reads `roadm`, one vertex a row."""
    R, two_pi, step = D(r), D(2 * math.pi), D(2 * math.pi / vertices)
    dist = segment_distance_sql("mx", "my", "s.x1", "s.y1", "s.x2", "s.y2")
    signs = "(VALUES (1), (-1)) sg(sgn)"
    return f"""lv AS (
  SELECT a.feature_id, a.k, a.x - o.x AS x, a.y - o.y AS y FROM roadm a JOIN roadm o ON o.feature_id = a.feature_id AND o.k = 0),
ls0 AS (
  SELECT a.feature_id, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
  FROM lv a JOIN lv b ON b.feature_id = a.feature_id AND b.k = a.k + 1),
ls AS (SELECT *, (x2 - x1) / len AS ux, (y2 - y1) / len AS uy FROM ls0),
-- circles: angles of all crossings
cbreak AS (
  SELECT feature_id, k, {D(0.0)} AS t FROM lv
  UNION ALL SELECT a.feature_id, a.k, atan2(b.y - a.y, b.x - a.x) + sgn * acos(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / (2 * {R}))
    FROM lv a JOIN lv b ON b.feature_id = a.feature_id AND b.k <> a.k, {signs}
    WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 2 * {R}
  UNION ALL SELECT a.feature_id, a.k, atan2(s.uy, s.ux) + sgn * pi() / 2 FROM lv a JOIN ls s ON s.feature_id = a.feature_id AND s.k IN (a.k - 1, a.k), {signs}
  UNION ALL SELECT feature_id, k, unnest([h + asin(q), h + pi() - asin(q)]) FROM (
    SELECT a.feature_id, a.k, atan2(s.uy, s.ux) AS h, (sgn * {R} - (s.ux * (a.y - s.y1) - s.uy * (a.x - s.x1))) / {R} AS q
    FROM lv a JOIN ls s ON s.feature_id = a.feature_id AND s.k NOT IN (a.k - 1, a.k), {signs}) WHERE abs(q) <= 1),
cturn AS (
  SELECT DISTINCT feature_id, k, t - floor(t / {two_pi}) * {two_pi} AS t FROM cbreak
  UNION ALL SELECT feature_id, k, {two_pi} FROM lv),
cpart AS (SELECT *, lead(t) OVER (PARTITION BY feature_id, k ORDER BY t) AS t2 FROM cturn),
cmid AS (
  SELECT p.*, a.x, a.y, (t + t2) / 2 AS m, a.x + {R} * cos((t + t2) / 2) AS mx, a.y + {R} * sin((t + t2) / 2) AS my
  FROM cpart p JOIN lv a USING (feature_id, k) WHERE t2 - t > {D(1e-12)}),
copen AS (
  SELECT * FROM cmid c
  WHERE NOT EXISTS (SELECT 1 FROM ls s WHERE s.feature_id = c.feature_id AND s.k NOT IN (c.k - 1, c.k) AND {dist} < {R})
    AND NOT EXISTS (SELECT 1 FROM ls s WHERE s.feature_id = c.feature_id AND s.k = c.k AND cos(m) * s.ux + sin(m) * s.uy > 0)
    AND NOT EXISTS (SELECT 1 FROM ls s WHERE s.feature_id = c.feature_id AND s.k = c.k - 1 AND cos(m) * s.ux + sin(m) * s.uy < 0)),
crun AS (SELECT *, CASE WHEN t <= lag(t2) OVER w + {D(1e-11)} THEN 0 ELSE 1 END AS fresh FROM copen WINDOW w AS (PARTITION BY feature_id, k ORDER BY t)),
cisle AS (SELECT *, sum(fresh) OVER (PARTITION BY feature_id, k ORDER BY t) AS isle FROM crun),
arcs AS (SELECT feature_id, k, isle, x, y, min(t) AS lo, max(t2) AS hi FROM cisle GROUP BY ALL),
avert AS (
  SELECT *, unnest([lo] || [i * {step} for i in range(CAST(floor(lo / {step} + {D(1e-9)}) AS BIGINT) + 1, CAST(ceil(hi / {step} - {D(1e-9)}) AS BIGINT))] || [hi]) AS t FROM arcs),
achord AS (
  SELECT *, x + {R} * cos(t) AS ax, y + {R} * sin(t) AS ay, lead(t) OVER (PARTITION BY feature_id, k, isle ORDER BY t) AS t2 FROM avert),
-- parallels: metres along the segment of all crossings
side AS (SELECT *, sgn, x1 - sgn * {R} * uy AS qx, y1 + sgn * {R} * ux AS qy FROM ls, {signs}),
sbreak AS (
  SELECT feature_id, k, sgn, unnest([{D(0.0)}, len]) AS t, len FROM side
  UNION ALL SELECT feature_id, k, sgn, unnest([-b - sqrt(h), -b + sqrt(h)]), len FROM (
    SELECT s.*, (qx - a.x) * ux + (qy - a.y) * uy AS b, {R} * {R} - ((qx - a.x) * uy - (qy - a.y) * ux) * ((qx - a.x) * uy - (qy - a.y) * ux) AS h
    FROM side s JOIN lv a ON a.feature_id = s.feature_id AND a.k NOT IN (s.k, s.k + 1)) WHERE h > 0
  UNION ALL SELECT feature_id, k, sgn, unnest([({R} - w0) / w1, (-{R} - w0) / w1]), len FROM (
    SELECT s.*, (qy - o.y1) * o.ux - (qx - o.x1) * o.uy AS w0, s.uy * o.ux - s.ux * o.uy AS w1
    FROM side s JOIN ls o ON o.feature_id = s.feature_id AND o.k <> s.k) WHERE abs(w1) > {D(1e-14)}
  UNION ALL SELECT feature_id, k, sgn, unnest([-t0 / t1, (olen - t0) / t1]), len FROM (
    SELECT s.*, o.len AS olen, (qx - o.x1) * o.ux + (qy - o.y1) * o.uy AS t0, s.ux * o.ux + s.uy * o.uy AS t1
    FROM side s JOIN ls o ON o.feature_id = s.feature_id AND o.k <> s.k) WHERE abs(t1) > {D(1e-14)}),
spart AS (
  SELECT feature_id, k, sgn, t, lead(t) OVER (PARTITION BY feature_id, k, sgn ORDER BY t) AS t2
  FROM (SELECT DISTINCT feature_id, k, sgn, t FROM sbreak WHERE t >= 0 AND t <= len)),
smid AS (
  SELECT p.*, a.qx, a.qy, a.ux, a.uy, a.qx + (t + t2) / 2 * a.ux AS mx, a.qy + (t + t2) / 2 * a.uy AS my
  FROM spart p JOIN side a USING (feature_id, k, sgn) WHERE t2 - t > {D(1e-12 * r)}),
sopen AS (SELECT * FROM smid c WHERE NOT EXISTS (SELECT 1 FROM ls s WHERE s.feature_id = c.feature_id AND s.k <> c.k AND {dist} < {R})),
srun AS (SELECT *, CASE WHEN t <= lag(t2) OVER w + {D(1e-11 * r)} THEN 0 ELSE 1 END AS fresh FROM sopen WINDOW w AS (PARTITION BY feature_id, k, sgn ORDER BY t)),
sisle AS (SELECT *, sum(fresh) OVER (PARTITION BY feature_id, k, sgn ORDER BY t) AS isle FROM srun),
sline AS (
  SELECT feature_id, sgn, max(t2) - min(t) AS arc, qx + min(t) * ux AS ax, qy + min(t) * uy AS ay, qx + max(t2) * ux AS ex, qy + max(t2) * uy AS ey
  FROM sisle GROUP BY feature_id, k, sgn, isle, qx, qy, ux, uy),
bpiece AS (
  SELECT feature_id, (hi - lo) * {R} AS arc, 0 AS n_vertices, {D(0.0)} AS chord,
    ({R} * {R} * (hi - lo) + {R} * x * (sin(hi) - sin(lo)) - {R} * y * (cos(hi) - cos(lo))) / 2 AS area FROM arcs
  UNION ALL SELECT feature_id, 0, 1, (ax * (y + {R} * sin(t2)) - (x + {R} * cos(t2)) * ay) / 2, 0 FROM achord WHERE t2 IS NOT NULL
  UNION ALL SELECT feature_id, arc, 1, -sgn * (ax * ey - ex * ay) / 2, -sgn * (ax * ey - ex * ay) / 2 FROM sline)"""


def _road_area() -> str:
    return _road_boundary(P.ROAD_RADIUS) + """,
rarea AS (SELECT feature_id, round(sum(area), 2) AS area FROM bpiece GROUP BY 1),
rstat AS (
  SELECT rp.feature_id, COUNT(*) AS n, COUNT(DISTINCT (x, y)) AS n_distinct FROM rp GROUP BY 1),
rwin AS (
  SELECT rstat.feature_id, n, n_distinct, area, n_distinct / area AS density FROM rstat JOIN rarea USING (feature_id))"""


def road_window_stats() -> str:
    return _with(PINGS, PINGS_M, ROADS_M, _road_pairs(), _road_area()) + "SELECT * FROM rwin ORDER BY density DESC, feature_id"


def top_road_by_density() -> str:
    return _with(PINGS, PINGS_M, ROADS_M, _road_pairs(), _road_area()) + (
        f"SELECT feature_id, n_distinct, density FROM rwin ORDER BY density DESC, feature_id LIMIT {P.FIRST_X}"
    )


ORACLES.update({"road_window_stats": road_window_stats, "top_road_by_density": top_road_by_density})


def road_wkt() -> str:
    return _with(ROADS_M) + """
SELECT feature_id, 'LINESTRING (' || string_agg(printf('%.3f %.3f', x, y), ', ' ORDER BY k) || ')' AS wkt
FROM roadm GROUP BY feature_id ORDER BY wkt"""


ORACLES["road_wkt"] = road_wkt


def study_area_pings_by_day() -> str:
    return _with(PINGS, PINGS_M) + f"""
SELECT {day_sql('sys_time')} AS day, COUNT(*) AS n_pings FROM pm WHERE {_study_area_sql('x', 'y')} GROUP BY 1"""


ORACLES["study_area_pings_by_day"] = study_area_pings_by_day


# ---------------------------------------------------------------------------
# wide inputs, multi-polygons, shared text ids
# ---------------------------------------------------------------------------
WIDE_PINGS = f"""wide AS (
  SELECT ping_id, sys_time + ((ping_id * 7) % 13) * {30 * 86400000} AS sys_time,
    {D(115.2)} + CAST((ping_id*7919) % 100003 AS DOUBLE)/100003*{D(2.4)} AS lng,
    {D(39.2)} + CAST((ping_id*15485863) % 100019 AS DOUBLE)/100019*{D(1.6)} AS lat
  FROM pings)"""

WIDE_ROADS = f"""wroadv AS (
  SELECT CAST(s_suppkey AS BIGINT) AS feature_id, r.range AS k,
    {D(115.7)} + CAST((CAST(s_suppkey AS BIGINT)*611953) % 10007 AS DOUBLE)/10007*{D(1.4)} + CAST(r.range AS DOUBLE)*{D(0.02)} AS lng,
    {D(39.4)} + CAST((CAST(s_suppkey AS BIGINT)*746773) % 10009 AS DOUBLE)/10009*{D(1.1)}
      + CAST((CAST(s_suppkey AS BIGINT)*(r.range+3)) % 7 AS DOUBLE)*{D(0.006)} AS lat
  FROM supplier, range(4) r),
roadm AS (SELECT feature_id, k, {mx('lng')} AS x, {my('lat')} AS y FROM wroadv),
segs AS (
  SELECT a.feature_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM roadm a JOIN roadm b ON a.feature_id = b.feature_id AND b.k = a.k + 1)"""

# squares: corners in order, ring by ring (part 1, 1/2 and 1/4 of the half side)
BLOCKS = f"""corner(k, sx, sy) AS (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)),
part(ring, p) AS (VALUES (0, {D(1.0)}), (1, {D(0.5)}), (2, {D(0.25)})),
blockv AS (
  SELECT CAST(s_suppkey AS BIGINT) AS feature_id, ring, k,
    {D(116.20)} + CAST((s_suppkey*49979687) % 10037 AS DOUBLE)/10037*{D(0.30)} + CAST(sx AS DOUBLE) * ({D(0.0005)} * pow({D(2.0)}, CAST(s_suppkey % 7 AS DOUBLE)) * p) AS lng,
    {D(39.80)} + CAST((s_suppkey*86028121) % 10039 AS DOUBLE)/10039*{D(0.25)} + CAST(sy AS DOUBLE) * ({D(0.0005)} * pow({D(2.0)}, CAST(s_suppkey % 7 AS DOUBLE)) * p) AS lat
  FROM supplier, part, corner),
blockm AS (SELECT feature_id, ring, k, {mx('lng')} AS x, {my('lat')} AS y FROM blockv),
box AS (SELECT feature_id, ring, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM blockm GROUP BY 1, 2)"""


def shape_measures() -> str:
    """Axis-aligned squares stay rectangles under Mercator: area by side lengths, shells plus, holes minus."""
    return _with(BLOCKS) + """
SELECT feature_id, 'MULTIPOLYGON' AS kind, CAST(COUNT(*) AS INTEGER) AS n_rings, CAST(2 AS INTEGER) AS n_members,
  round(SUM((CASE WHEN ring = 1 THEN -1 ELSE 1 END) * (x1 - x0) * (y1 - y0)), 2) AS area
FROM box GROUP BY 1"""


def ring_nesting() -> str:
    """Squares: one lies in another if its box does."""
    return _with(BLOCKS) + """
SELECT a.feature_id, CAST(a.ring AS INTEGER) AS ring, COUNT(b.ring) AS depth,
  CAST(arg_min(b.ring, (b.x1 - b.x0) * (b.y1 - b.y0)) AS INTEGER) AS parent, round((a.x1 - a.x0) * (a.y1 - a.y0), 2) AS area
FROM box a LEFT JOIN box b ON a.feature_id = b.feature_id AND b.ring <> a.ring AND b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1
GROUP BY a.feature_id, a.ring, a.x0, a.x1, a.y0, a.y1"""


ORACLES["ring_nesting"] = ring_nesting


def block_totals() -> str:
    """Strictly inside the outer square and not in the closed hole, or strictly inside the inner square."""
    inside = lambda b: f"x > {b}.x0 AND x < {b}.x1 AND y > {b}.y0 AND y < {b}.y1"
    return _with(PINGS, PINGS_M, BLOCKS) + f""",
hit AS (
  SELECT a.feature_id, x, y FROM pm, box a JOIN box b ON a.feature_id = b.feature_id AND b.ring = 1 JOIN box c ON a.feature_id = c.feature_id AND c.ring = 2
  WHERE a.ring = 0 AND (({inside('a')} AND NOT (x >= b.x0 AND x <= b.x1 AND y >= b.y0 AND y <= b.y1)) OR ({inside('c')})))
SELECT feature_id, COUNT(*) AS n, COUNT(DISTINCT (x, y)) AS n_distinct FROM hit GROUP BY 1"""


def road_visits_sql() -> str:
    return road_visits_unordered().replace(ROADS_M, WIDE_ROADS)


ORACLES["road_visits_sql"] = road_visits_sql


def wide_line_tiles() -> str:
    return line_tiles().replace(ROADS_M, WIDE_ROADS)


def wide_line_tiles_beijing() -> str:
    x0, y0, x1, y1 = P.BEIJING_BOX_3857
    env = f"env AS (SELECT {D(x0)} AS min_x, {D(y0)} AS min_y, {D(x1)} AS max_x, {D(y1)} AS max_y)"
    tiles = _line_pix(env) + _tiles_of("(SELECT *, CAST(1.0 AS DOUBLE) AS intensity FROM lp)", "hits", "intensity")
    return tiles.replace(ROADS_M, WIDE_ROADS)


ORACLES.update({"wide_line_tiles": wide_line_tiles, "wide_line_tiles_beijing": wide_line_tiles_beijing})


def road_buffers() -> str:
    return _with(WIDE_ROADS, _road_boundary(P.ROAD_RADIUS)) + """
SELECT feature_id, round(sum(area), 2) AS area, round(sum(arc), 3) AS perimeter, CAST(sum(n_vertices) AS BIGINT) AS n_vertices,
  round(sum(chord), 0) AS outline_area
FROM bpiece GROUP BY feature_id"""


ORACLES["road_buffers"] = road_buffers


def road_visits_by_text_id() -> str:
    return _with(PINGS, PINGS_M, WIDE_ROADS, _road_pairs()) + """
SELECT 'R-' || CASE WHEN feature_id % 3 = 0 THEN feature_id + 1 ELSE feature_id END AS text_id, COUNT(*) AS join_count FROM rp GROUP BY 1"""


def segment_capsules(vertices: int = 32) -> str:
    """Half circles of vertices / 2 steps around both ends; area of the polygon by shoelace."""
    half, r = vertices // 2, D(P.ROAD_RADIUS)
    return _with(ROADS_M) + f""",
arc AS (
  SELECT feature_id, seg_idx, side.range AS side, k.range AS k,
    (CASE WHEN side.range = 0 THEN x2 ELSE x1 END) + {r} * cos(atan2(y2 - y1, x2 - x1) + (side.range * 2 - 1) * {D(math.pi / 2)} + CAST(k.range AS DOUBLE) * {D(math.pi / half)}) AS x,
    (CASE WHEN side.range = 0 THEN y2 ELSE y1 END) + {r} * sin(atan2(y2 - y1, x2 - x1) + (side.range * 2 - 1) * {D(math.pi / 2)} + CAST(k.range AS DOUBLE) * {D(math.pi / half)}) AS y
  FROM segs, range(2) side, range({half + 1}) k),
ring AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy
  FROM arc WINDOW w AS (PARTITION BY feature_id, seg_idx ORDER BY side, k))
SELECT feature_id, CAST(seg_idx AS INTEGER) AS seg_idx, CAST(COUNT(*) + 1 AS INTEGER) AS n_vertices,
  round(abs(SUM((x - fx) * (coalesce(ny, fy) - fy) - (coalesce(nx, fx) - fx) * (y - fy))) / {D(2.0)}, 2) AS area,
  round(min(x), 3) AS min_x, round(min(y), 3) AS min_y, round(max(x), 3) AS max_x, round(max(y), 3) AS max_y
FROM ring GROUP BY 1, 2"""


def wide_winter_pings() -> str:
    ts = f"(TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(sys_time + {OFF}))"
    return _with(PINGS, WIDE_PINGS) + f"""
SELECT ping_id, sys_time, CAST(month({ts}) AS INTEGER) AS month FROM wide WHERE month({ts}) IN (12, 1, 2)"""


def wide_hourly_grid_counts() -> str:
    """The bounds are written out: from 2024-06-01 to 2024-07-16, whole hours, both ends open."""
    lo, hi = 1717200000000, 1721088000000
    text = hourly_grid_counts()
    old_lo, old_hi = hour_slices(P.GRID_FROM_TIME, P.GRID_TO_TIME, OFF)
    text = text.replace(f"sys_time > {old_lo} AND sys_time < {old_hi}", f"sys_time > {lo} AND sys_time < {hi}")
    return text.replace("SELECT * FROM pings WHERE", "SELECT * FROM wide WHERE").replace(_with(PINGS), _with(PINGS, WIDE_PINGS))


_WIDE_M = f"wm AS (SELECT ping_id, {mx('lng')} AS x, {my('lat')} AS y FROM wide)"


def _wide_heat(envelope_cte: str) -> str:
    text = _heat(envelope_cte).replace("FROM pm, range", "FROM wm, range").replace("pm.x, pm.y", "wm.x, wm.y")
    return text.replace(PINGS_M, ",\n".join([WIDE_PINGS, _WIDE_M]))


def wide_heat_tiles() -> str:
    return _wide_heat(_env_pings().replace("FROM pm", "FROM wm")) + _tiles_of("heat", "n_sum", "intensity")


def wide_heat_tiles_beijing() -> str:
    x0, y0, x1, y1 = P.BEIJING_BOX_3857
    return _wide_heat(f"env AS (SELECT {D(x0)} AS min_x, {D(y0)} AS min_y, {D(x1)} AS max_x, {D(y1)} AS max_y)") + _tiles_of("heat", "n_sum", "intensity")


def wide_lines_in_box() -> str:
    return _with(WIDE_ROADS) + _in_box_ids()


def _corrected() -> str:
    """The corrected positions as Mercator points `pm` (full precision)."""
    inner = gcj_to_wgs().replace("round(wl, 8)", "wl").replace("round(wt, 8)", "wt")
    return f"fixed AS ({inner}),\npm AS (SELECT ping_id, {mx('wgs_lng')} AS x, {my('wgs_lat')} AS y FROM fixed)"


def heat_pixels_gcj() -> str:
    return heat_pixels().replace(PINGS_M, _corrected())


def tile_offsets_gcj() -> str:
    return tile_offsets().replace(PINGS_M, _corrected())


def road_tile_offsets() -> str:
    return tile_offsets().replace(_with(PINGS, PINGS_M, _env_pings()), _with(ROADS_M, _env_roads()))


def road_tile_spans() -> str:
    return tile_spans().replace(_with(PINGS, PINGS_M, _env_pings(), _spans(P.MIN_ZOOM, P.MAX_ZOOM)), _with(ROADS_M, _env_roads(), _spans(P.MIN_ZOOM, P.MAX_ZOOM)))


def wide_segment_capsules() -> str:
    numbered = WIDE_ROADS.replace("SELECT a.feature_id, a.x AS x1", "SELECT a.feature_id, a.k AS seg_idx, a.x AS x1")
    return segment_capsules().replace(ROADS_M, numbered)


def wide_road_tile_offsets() -> str:
    return road_tile_offsets().replace(ROADS_M, WIDE_ROADS)


def wide_road_tile_spans() -> str:
    return road_tile_spans().replace(ROADS_M, WIDE_ROADS)


ORACLES.update(
    {
        "wide_segment_capsules": wide_segment_capsules,
        "wide_road_tile_offsets": wide_road_tile_offsets,
        "wide_road_tile_spans": wide_road_tile_spans,
        "poi_circles": poi_circles,
        "shape_measures": shape_measures,
        "block_totals": block_totals,
        "road_visits_by_text_id": road_visits_by_text_id,
        "segment_capsules": segment_capsules,
        "wide_winter_pings": wide_winter_pings,
        "wide_hourly_grid_counts": wide_hourly_grid_counts,
        "wide_heat_tiles": wide_heat_tiles,
        "wide_heat_tiles_beijing": wide_heat_tiles_beijing,
        "wide_lines_in_box": wide_lines_in_box,
        "heat_pixels_gcj": heat_pixels_gcj,
        "tile_offsets_gcj": tile_offsets_gcj,
        "road_tile_offsets": road_tile_offsets,
        "road_tile_spans": road_tile_spans,
        "gcj_to_wgs_sql": gcj_to_wgs,
    }
)
