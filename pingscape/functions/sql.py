"""SQL-callable functions.

For users who write SQL strings, the projections and predicates are
registered as Spark SQL scalar functions (`CREATE TEMPORARY FUNCTION ...
RETURN <expression>`).  These are SQL-bodied functions: Spark inlines the body
into the query plan, so they run as native expressions (no Python, no UDF).

A distance join in SQL is an equi-join on cells:

    SELECT ... FROM (SELECT *, shape_cells(parts, 300D, 300D) AS cells FROM roads)
    LATERAL VIEW inline(cells) c AS cx, cy JOIN pings ON cell_of(x, 300D) = cx AND cell_of(y, 300D) = cy
    WHERE shape_near(x, y, 300D, parts)

A shape has every cell once and a point one cell, so every pair meets once.

Where only counts are asked for, `cell_quarters` refines the cells: one wholly within the
radius (`inside`) takes the number of its points, and only points of the smallest cells
along the buffer's edge are compared (see `plans.colocation.road_visits_sql`).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .crs import GCJ_MAX_ROUNDS, GCJ_TOLERANCE, MERCATOR_RADIUS, gcj_delta_sql
from .geom import CROSSING_SQL, ON_EDGE_SQL, segment_distance_sql
from .tiles import EQUATOR

_R = repr(MERCATOR_RADIUS)
_E = repr(EQUATOR)
_PARTS = "ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
_EDGE = {"x1": "e.x1", "y1": "e.y1", "x2": "e.x2", "y2": "e.y2"}
_D_LNG, _D_LAT = gcj_delta_sql("lng", "lat")
_S_LNG, _S_LAT = gcj_delta_sql("s.wl", "s.wt")
_TOL = f"CAST({GCJ_TOLERANCE!r} AS DOUBLE)"

# The inverse shift as a fold over the rounds: a finished state is handed on, so the
# offset is computed only in the rounds that a position needs.
_INVERSE = (
    "transform(array(aggregate(sequence(1, "
    f"{GCJ_MAX_ROUNDS - 1}), "
    f"named_struct('wl', lng - {_D_LNG}, 'wt', lat - {_D_LAT}, 'done', abs(lng) <= {_TOL} AND abs(lat) <= {_TOL}), "
    "(s, i) -> CASE WHEN s.done THEN s ELSE "
    f"transform(array(named_struct('wl', lng - {_S_LNG}, 'wt', lat - {_S_LAT})), "
    f"n -> named_struct('wl', n.wl, 'wt', n.wt, 'done', abs(n.wl - s.wl) <= {_TOL} AND abs(n.wt - s.wt) <= {_TOL}))[0] END)), "
    "r -> named_struct('lng', r.wl, 'lat', r.wt))[0]"
)

FUNCTIONS = {
    "shape_edges": (
        f"parts {_PARTS}",
        "ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>",
        "flatten(transform(parts, p -> zip_with(slice(p, 1, greatest(size(p) - 1, 0)), slice(p, 2, greatest(size(p) - 1, 0)), "
        "(a, b) -> named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))))",
    ),
    "mercator_x": ("lng DOUBLE", "DOUBLE", f"radians(lng) * CAST({_R} AS DOUBLE)"),
    "mercator_y": ("lat DOUBLE", "DOUBLE", f"ln(tan(pi() / 4 + radians(lat) / 2)) * CAST({_R} AS DOUBLE)"),
    "planar_distance": (
        "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE",
        "DOUBLE",
        "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))",
    ),
    "tile_x": ("x DOUBLE, z INT", "INT", f"CAST((x + CAST({_E} AS DOUBLE) / 2) / CAST({_E} AS DOUBLE) * pow(2, z) AS INT)"),
    "tile_y": ("y DOUBLE, z INT", "INT", f"CAST((CAST({_E} AS DOUBLE) / 2 - y) / CAST({_E} AS DOUBLE) * pow(2, z) AS INT)"),
    "tile_corner_x": ("tx INT, z INT", "DOUBLE", f"tx * CAST({_E} AS DOUBLE) / pow(2, z) - CAST({_E} AS DOUBLE) / 2"),
    "tile_corner_y": ("ty INT, z INT", "DOUBLE", f"CAST({_E} AS DOUBLE) / 2 - ty * CAST({_E} AS DOUBLE) / pow(2, z)"),
    "tile_corner_lat": ("ty INT, z INT", "DOUBLE", "degrees(atan(sinh(pi() * (1 - 2 * ty / pow(2, z)))))"),
    "tile_corner_lng": ("tx INT, z INT", "DOUBLE", "tx / pow(2, z) * 360 - 180"),
    "wgs_to_gcj_lng": ("lng DOUBLE, lat DOUBLE", "DOUBLE", f"lng + {_D_LNG}"),
    "wgs_to_gcj_lat": ("lng DOUBLE, lat DOUBLE", "DOUBLE", f"lat + {_D_LAT}"),
    "gcj_to_wgs": ("lng DOUBLE, lat DOUBLE", "STRUCT<lng: DOUBLE, lat: DOUBLE>", _INVERSE),
    "gcj_to_wgs_lng": ("lng DOUBLE, lat DOUBLE", "DOUBLE", "gcj_to_wgs(lng, lat).lng"),
    "gcj_to_wgs_lat": ("lng DOUBLE, lat DOUBLE", "DOUBLE", "gcj_to_wgs(lng, lat).lat"),
    # shapes are arrays of parts (see functions.geom)
    "shape_within": (
        f"x DOUBLE, y DOUBLE, parts {_PARTS}",
        "BOOLEAN",
        "aggregate(shape_edges(parts), 0, (acc, e) -> CASE WHEN acc < 0 OR "
        + ON_EDGE_SQL.format(px="x", py="y", **_EDGE)
        + " THEN -1 ELSE acc + "
        + CROSSING_SQL.format(px="x", py="y", **_EDGE)
        + " END) % 2 = 1",
    ),
    "shape_contains_box": (
        f"x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, parts {_PARTS}",
        "BOOLEAN",
        "forall(flatten(parts), p -> p.x >= x0 AND p.x <= x1 AND p.y >= y0 AND p.y <= y1) AND "
        "exists(shape_edges(parts), e -> (e.x1 + e.x2) / 2 > x0 AND (e.x1 + e.x2) / 2 < x1 AND (e.y1 + e.y2) / 2 > y0 AND (e.y1 + e.y2) / 2 < y1)",
    ),
    "shape_near": (
        f"x DOUBLE, y DOUBLE, radius DOUBLE, parts {_PARTS}",
        "BOOLEAN",
        "exists(shape_edges(parts), e -> " + segment_distance_sql("x", "y", "e.x1", "e.y1", "e.x2", "e.y2") + " < radius)",
    ),
}

# The cells that a shape's edges, widened by `pad`, meet: column by column, as the equi-join
# key of a distance join in SQL.  A cell is one number while repeats are taken out (a hash
# set), then a struct for `inline`.
_WIDE = "(pad + 1e-6D * (cell + pad))"
_COLUMN = f"sequence(floor((least(e.x1, e.x2) - {_WIDE}) / cell), floor((greatest(e.x1, e.x2) + {_WIDE}) / cell))"
_AT = "CASE WHEN e.x1 = e.x2 THEN {flat} ELSE e.y1 + ({x} - e.x1) * ((e.y2 - e.y1) / (e.x2 - e.x1)) END"
_FROM = _AT.format(flat="e.y1", x=f"greatest(least(e.x1, e.x2), c * cell - {_WIDE})")
_TO = _AT.format(flat="e.y2", x=f"least(greatest(e.x1, e.x2), (c + 1) * cell + {_WIDE})")
_ROWS = f"sequence(floor((least({_FROM}, {_TO}) - {_WIDE}) / cell), floor((greatest({_FROM}, {_TO}) + {_WIDE}) / cell))"
_POINT = "if(size(p) = 1, transform(p, v -> named_struct('x1', v.x, 'y1', v.y, 'x2', v.x, 'y2', v.y)), array())"
_CELLS = f"flatten(transform({_COLUMN}, c -> transform({_ROWS}, d -> c * 4294967296 + d + 2147483648)))"
FUNCTIONS["shape_cells"] = (
    f"parts {_PARTS}, pad DOUBLE, cell DOUBLE",
    "ARRAY<STRUCT<cx: BIGINT, cy: BIGINT>>",
    f"transform(array_distinct(flatten(transform(concat(shape_edges(parts), flatten(transform(parts, p -> {_POINT}))), e -> {_CELLS}))), "
    "k -> named_struct('cx', shiftright(k, 32), 'cy', (k & 4294967295) - 2147483648))",
)
FUNCTIONS["cell_of"] = ("v DOUBLE, cell DOUBLE", "BIGINT", "floor(v / cell)")

# Cells with the edges that come within `radius` of one of their points, each with its
# distance `d` from the cell's middle.  The middle decides, half a diagonal (and a margin
# for rounding) less or more: a cell is `inside` if an edge is near for all its points.
# Halves are exact, so a point's cell lies in its cell of twice the side.
_EDGES = "ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE, d: DOUBLE>>"
_CELL = f"STRUCT<level: INT, cx: BIGINT, cy: BIGINT, inside: BOOLEAN, edges: {_EDGES}>"


def _cell(level: str, cx: str, cy: str, side: str, edges: str) -> str:
    """A cell of side `side` as a struct, its edges taken out of `edges`."""
    reach = f"({side} * 0.7071067811865476D + 1e-6D * ({side} + radius))"
    d = segment_distance_sql("m.x", "m.y", "e.x1", "e.y1", "e.x2", "e.y2")
    near = f"filter(transform({edges}, e -> named_struct('x1', e.x1, 'y1', e.y1, 'x2', e.x2, 'y2', e.y2, 'd', {d})), s -> s.d <= radius + {reach})"
    return (
        f"transform(transform(array(named_struct('x', ({cx} + 0.5D) * {side}, 'y', ({cy} + 0.5D) * {side})), m -> {near}), "
        f"n -> CASE WHEN exists(n, s -> s.d < radius - {reach}) THEN named_struct('level', {level}, 'cx', {cx}, 'cy', {cy}, 'inside', true, 'edges', slice(n, 1, 0)) "
        f"ELSE named_struct('level', {level}, 'cx', {cx}, 'cy', {cy}, 'inside', false, 'edges', n) END)[0]"
    )


FUNCTIONS["shape_cell"] = (
    "cx BIGINT, cy BIGINT, cell DOUBLE, radius DOUBLE, edges ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>",
    _CELL,
    _cell("0", "cx", "cy", "cell", "edges"),
)
# the quarters of a cell of side `cell` that an edge comes near; a cell that lies inside stays whole
FUNCTIONS["cell_quarters"] = (
    f"c {_CELL}, cell DOUBLE, radius DOUBLE",
    f"ARRAY<{_CELL}>",
    "CASE WHEN c.inside THEN array(c) ELSE filter(transform(sequence(0, 3), i -> "
    + _cell("c.level + 1", "(c.cx * 2 + i % 2)", "(c.cy * 2 + i div 2)", "(cell / 2)", "c.edges")
    + "), q -> q.inside OR size(q.edges) > 0) END",
)
_FIRST = segment_distance_sql("x", "y", "edges[0].x1", "edges[0].y1", "edges[0].x2", "edges[0].y2")
FUNCTIONS["edges_near"] = (
    f"x DOUBLE, y DOUBLE, radius DOUBLE, edges {_EDGES}",
    "BOOLEAN",
    # mostly one: compared without a walk over the array
    f"CASE WHEN size(edges) = 1 THEN {_FIRST} < radius ELSE exists(edges, e -> "
    + segment_distance_sql("x", "y", "e.x1", "e.y1", "e.x2", "e.y2") + " < radius) END",
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions in this session; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)

