"""Planar geometry as Spark column expressions.

Shapes have no geometry type here.  A shape is a column `parts` of type
`array<array<struct<x: double, y: double>>>`:

* point       -> one part with one vertex,
* line string -> one part, the vertices in order,
* multi line  -> one part per line,
* polygon     -> one part per ring (shell first, then holes), each ring closed,
* multi polygon -> all rings of all members.

Points are two double columns.  All predicates are exact arithmetic on doubles
and are evaluated on the executors by built-in (JVM) expressions; higher-order
array functions (`aggregate`, `exists`, `transform`) walk the vertices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import col_of

POINT_TYPE = "struct<x:double,y:double>"
PARTS_TYPE = "array<array<struct<x:double,y:double>>>"
EDGE_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


# ---------------------------------------------------------------------------
# distances
# ---------------------------------------------------------------------------
def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance.  The oracle SQL uses the same text:
    `sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))`."""
    dx = col_of(x1) - col_of(x2)
    dy = col_of(y1) - col_of(y2)
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a closed segment (degenerate segment = point)."""
    px, py, x1, y1, x2, y2 = map(col_of, (px, py, x1, y1, x2, y2))
    dx = x2 - x1
    dy = y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / len2))
    )
    cx = x1 + t * dx
    cy = y1 + t * dy
    return distance(px, py, cx, cy)


def ready_segment_distance(px, py, seg: Column) -> Column:
    """`segment_distance` to a segment given as struct (x1, y1, dx, dy, len2): the
    same arithmetic with the point-independent part done beforehand."""
    px, py = col_of(px), col_of(py)
    t = F.when(seg["len2"] == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - seg["x1"]) * seg["dx"] + (py - seg["y1"]) * seg["dy"]) / seg["len2"]))
    )
    return distance(px, py, seg["x1"] + t * seg["dx"], seg["y1"] + t * seg["dy"])


SEGMENT_DISTANCE_SQL = (
    "sqrt(({px} - ({x1} + {t} * ({x2} - {x1}))) * ({px} - ({x1} + {t} * ({x2} - {x1}))) + "
    "({py} - ({y1} + {t} * ({y2} - {y1}))) * ({py} - ({y1} + {t} * ({y2} - {y1}))))"
)


def segment_distance_sql(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """SQL text with the same evaluation order as `segment_distance` (for the oracle)."""
    dx = f"({x2} - {x1})"
    dy = f"({y2} - {y1})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = (
        f"(CASE WHEN {len2} = 0 THEN CAST(0.0 AS DOUBLE) ELSE greatest(CAST(0.0 AS DOUBLE), "
        f"least(CAST(1.0 AS DOUBLE), (({px} - {x1}) * {dx} + ({py} - {y1}) * {dy}) / {len2})) END)"
    )
    return SEGMENT_DISTANCE_SQL.format(px=px, py=py, x1=x1, y1=y1, x2=x2, y2=y2, t=t)


# ---------------------------------------------------------------------------
# shape structure
# ---------------------------------------------------------------------------
def vertices(parts) -> Column:
    """All vertices of all parts, flattened."""
    return F.flatten(col_of(parts))


def part_edges(ring) -> Column:
    """Consecutive vertex pairs of one part as `array<EDGE_TYPE>`."""
    ring = col_of(ring)
    n = F.size(ring)
    return F.when(n < 2, F.array().cast(f"array<{EDGE_TYPE}>")).otherwise(
        F.zip_with(
            F.slice(ring, 1, n - 1),
            F.slice(ring, 2, n - 1),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )
    )


def edges(parts) -> Column:
    """Edges of every part (segments of lines, sides of rings)."""
    return F.flatten(F.transform(col_of(parts), part_edges))


def segments_of(parts) -> Column:
    """`edges`, and for a part with a single vertex one edge of length 0."""
    point = lambda p: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2"))
    return F.flatten(F.transform(col_of(parts), lambda p: F.when(F.size(p) == 1, F.transform(p, point)).otherwise(part_edges(p))))


def envelope(parts) -> Column:
    """Bounding box of a shape as struct(min_x, min_y, max_x, max_y)."""
    v = vertices(parts)
    xs = F.transform(v, lambda p: p["x"])
    ys = F.transform(v, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def ring_signed_area2(ring) -> Column:
    """Twice the signed shoelace area of one closed ring.

    Coordinates are taken relative to the ring's first vertex: with projected
    metres (~1e7) the raw cross products are ~1e14 and cancel to the area, which
    would leave the result at the mercy of rounding and summation order.
    """
    ring = col_of(ring)
    first = F.try_element_at(ring, F.lit(1))
    x0, y0 = first["x"], first["y"]
    return F.aggregate(
        part_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc + ((e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)),
    )


def _contains(ring: Column, other: Column) -> Column:
    """Whether a ring surrounds another one (the middle of the other's first edge decides)."""
    a, b = F.try_element_at(other, F.lit(1)), F.try_element_at(other, F.lit(2))
    x, y = (a["x"] + b["x"]) / 2.0, (a["y"] + b["y"]) / 2.0
    crossed = F.aggregate(part_edges(ring), F.lit(0), lambda acc, e: acc + F.when(_crosses(x, y, e), 1).otherwise(0))
    return (crossed % 2) == 1


def ring_depths(parts) -> Column:
    """Per ring, how many of the other rings surround it: even for shells, odd for holes.

    Holds for any orientation of the rings and for any number of members."""
    parts = col_of(parts)
    others = lambda r, i: F.filter(parts, lambda o, j: (j != i) & _contains(o, r))
    return F.transform(parts, lambda r, i: F.size(others(r, i)))


def polygon_members(parts) -> Column:
    """The rings grouped by member: every shell with the holes directly inside it."""
    parts = col_of(parts)
    rings = F.zip_with(parts, ring_depths(parts), lambda r, d: F.struct(r.alias("ring"), d.alias("depth")))
    shells = F.filter(rings, lambda r: r["depth"] % 2 == 0)
    holes = lambda s: F.filter(rings, lambda h: (h["depth"] == s["depth"] + 1) & _contains(s["ring"], h["ring"]))
    return F.transform(shells, lambda s: F.concat(F.array(s["ring"]), F.transform(holes(s), lambda h: h["ring"])))


def polygon_area(parts) -> Column:
    """Area of a polygon or multi-polygon given as rings: shells count, holes are taken off (shoelace)."""
    parts = col_of(parts)
    areas = F.zip_with(parts, ring_depths(parts), lambda r, d: F.when(d % 2 == 0, 1.0).otherwise(-1.0) * F.abs(ring_signed_area2(r)) / 2.0)
    return F.aggregate(areas, F.lit(0.0), lambda acc, v: acc + v)


def line_length(parts) -> Column:
    """Total length of all parts."""
    return F.aggregate(
        edges(parts), F.lit(0.0), lambda acc, e: acc + distance(e["x1"], e["y1"], e["x2"], e["y2"])
    )


# ---------------------------------------------------------------------------
# predicates
# ---------------------------------------------------------------------------
def _crosses(px: Column, py: Column, e: Column) -> Column:
    """Edge crosses the horizontal ray from (px, py) towards +x (half-open rule)."""
    return ((e["y1"] > py) != (e["y2"] > py)) & (
        px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    )


def _on_edge(px: Column, py: Column, e: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    return (
        (cross == 0)
        & (px >= F.least(e["x1"], e["x2"]))
        & (px <= F.greatest(e["x1"], e["x2"]))
        & (py >= F.least(e["y1"], e["y2"]))
        & (py <= F.greatest(e["y1"], e["y2"]))
    )


def crossing_count(px, py, edge_array) -> Column:
    """Number of polygon edges crossed by the ray from the point to +x."""
    px, py = col_of(px), col_of(py)
    return F.aggregate(
        col_of(edge_array), F.lit(0), lambda acc, e: acc + F.when(_crosses(px, py, e), 1).otherwise(0)
    )


def on_boundary(px, py, edge_array) -> Column:
    """The point lies exactly on one of the edges."""
    px, py = col_of(px), col_of(py)
    return F.exists(col_of(edge_array), lambda e: _on_edge(px, py, e))


def within_polygon(px, py, edge_array) -> Column:
    """Strictly inside (boundary excluded): odd crossing parity and not on an edge.

    One fold over the edges; once the point is found on an edge the state stays
    negative.  Works for holes and multi-polygons because every ring's edges
    are in the array.
    """
    px, py = col_of(px), col_of(py)
    state = F.aggregate(
        col_of(edge_array),
        F.lit(0),
        lambda acc, e: F.when((acc < 0) | _on_edge(px, py, e), -1).otherwise(acc + F.when(_crosses(px, py, e), 1).otherwise(0)),
    )
    return (state > 0) & (state % 2 == 1)


CROSSING_SQL = (
    "CASE WHEN (({y1} > {py}) <> ({y2} > {py})) AND "
    "({px} < ({x2} - {x1}) * ({py} - {y1}) / ({y2} - {y1}) + {x1}) THEN 1 ELSE 0 END"
)
ON_EDGE_SQL = (
    "(({x2} - {x1}) * ({py} - {y1}) - ({y2} - {y1}) * ({px} - {x1}) = 0 AND "
    "{px} >= least({x1}, {x2}) AND {px} <= greatest({x1}, {x2}) AND "
    "{py} >= least({y1}, {y2}) AND {py} <= greatest({y1}, {y2}))"
)


def within_box(px, py, min_x, min_y, max_x, max_y) -> Column:
    """Strictly inside an axis-aligned rectangle (boundary excluded)."""
    px, py = col_of(px), col_of(py)
    return (px > min_x) & (px < max_x) & (py > min_y) & (py < max_y)


def box_contains_line(parts, min_x, min_y, max_x, max_y) -> Column:
    """A rectangle contains a line: every vertex in the closed box, and the line
    is not wholly on the border (some segment midpoint strictly inside).

    A box is convex, so vertices inside imply every segment is inside; a
    segment whose midpoint is on the border lies along one side.
    """
    v = vertices(parts)
    inside_closed = F.forall(
        v, lambda p: (p["x"] >= min_x) & (p["x"] <= max_x) & (p["y"] >= min_y) & (p["y"] <= max_y)
    )
    touches_interior = F.exists(
        edges(parts),
        lambda e: within_box(
            (e["x1"] + e["x2"]) / 2.0, (e["y1"] + e["y2"]) / 2.0, min_x, min_y, max_x, max_y
        ),
    )
    return inside_closed & touches_interior


# ---------------------------------------------------------------------------
# WKT
# ---------------------------------------------------------------------------
# keyword, then optionally Z / M / ZM, then EMPTY or a body in parentheses
_WKT = r"(?is)^([a-z]+)\s*(?:zm|z|m)?\s*(empty|\(.*\))$"
_KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")


def _wkt_text(text) -> Column:
    """The text without surrounding white space and SRID prefix."""
    return F.regexp_replace(F.trim(col_of(text)), r"(?i)^srid\s*=\s*\d+\s*;\s*", "")


def wkt_kind(text) -> Column:
    """Upper-case geometry keyword of a WKT text (POINT, LINESTRING, POLYGON, ...)."""
    return F.upper(F.regexp_extract(_wkt_text(text), r"(?i)^(MULTI)?(POINT|LINESTRING|POLYGON|[a-z]+?)(?=\s*(?:zm|z|m)?\s*(?:\(|empty|$))", 0))


def _nesting(body: Column) -> Column:
    """Depth of a well-formed body, 0 for any other: vertex lists are folded level by level."""
    folded = F.regexp_replace(body, r"[^(),]+", "v")
    depth = F.lit(0)
    for level in (1, 2, 3):
        folded = F.regexp_replace(folded, ",v(?=[,)])", "")
        depth = F.when((depth == 0) & (folded == "(v)"), F.lit(level)).otherwise(depth)
        folded = F.replace(folded, F.lit("(v)"), F.lit("v"))
    return depth


def wkt_parts(text) -> Column:
    """Decode WKT text into `parts` (see module doc).  Malformed text -> null.

    Z and M values and an SRID prefix are read over; an EMPTY shape has no parts.
    The text is well formed when its parentheses nest as its kind asks for and
    every vertex is two to four numbers.  One projection over the whole column.
    """
    t = _wkt_text(text)
    kind = wkt_kind(text)
    body = F.regexp_replace(F.regexp_extract(t, _WKT, 2), r"\s*([(),])\s*", "$1")
    empty = F.lower(body) == "empty"
    depth = _nesting(body)
    wanted = F.when(kind.isin("POINT", "LINESTRING"), F.lit(1)).when(kind == "MULTIPOLYGON", F.lit(3)).otherwise(F.lit(2))
    single = (kind == "MULTIPOINT") & (depth == 1)  # MULTIPOINT (1 1, 2 2)
    # separators between parts, at any depth, become "|"
    flat = F.regexp_replace(F.regexp_replace(body, r"\)+,\(+", "|"), r"[()]", "")
    flat = F.when(single, F.replace(flat, F.lit(","), F.lit("|"))).otherwise(flat)

    def vertex(v: Column) -> Column:
        n = F.split(v, r"\s+")
        number = lambda i: F.try_element_at(n, F.lit(i)).try_cast("double")
        good = F.size(n).between(2, 4) & number(1).isNotNull() & number(2).isNotNull()
        return F.when(good, F.struct(number(1).alias("x"), number(2).alias("y")))

    parts = F.transform(F.split(flat, r"\|"), lambda p: F.transform(F.split(p, ","), vertex))
    valid = kind.isin(*_KINDS) & ((depth == wanted) | single) & F.forall(parts, lambda p: F.forall(p, lambda v: v.isNotNull()))
    valid = valid & ((kind != "POINT") | (F.size(F.flatten(parts)) == 1))
    none = F.array().cast(PARTS_TYPE)
    return F.when(kind.isin(*_KINDS) & empty, none).when(valid, parts).cast(PARTS_TYPE)


def _vertex_text(v: Column, decimals: int | None = None) -> Column:
    if decimals is None:
        # shortest text that reads back to the same double
        return F.concat(v["x"].cast("string"), F.lit(" "), v["y"].cast("string"))
    return F.format_string(f"%.{int(decimals)}f %.{int(decimals)}f", v["x"], v["y"])


def to_wkt(kind, parts, decimals: int | None = None) -> Column:
    """Encode `parts` as WKT text (all six kinds; without parts, `KIND EMPTY`).

    `decimals=None` writes every coordinate exactly (round-trips bit for bit);
    a number writes fixed decimals (stable text for sorting and comparing).
    """
    kind, parts = col_of(kind), col_of(parts)
    listed = lambda a, f: F.concat(F.lit("("), F.array_join(F.transform(a, f), ", "), F.lit(")"))
    vertex = lambda v: _vertex_text(v, decimals)
    ring = lambda p: listed(p, vertex)
    first = F.try_element_at(parts, F.lit(1))
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), ring(first))
        .when(kind.isin("POLYGON", "MULTILINESTRING", "MULTIPOINT"), listed(parts, ring))
        .when(kind == "MULTIPOLYGON", listed(polygon_members(parts), lambda m: listed(m, ring)))
    )
    return F.when(F.size(parts) == 0, F.concat(kind, F.lit(" EMPTY"))).otherwise(F.concat(kind, F.lit(" "), body))
