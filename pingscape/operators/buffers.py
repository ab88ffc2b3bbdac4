"""Buffers of shapes: circle and capsule rings, and the exact boundary of a line's buffer.

The buffer of a polyline is the union of the capsules around its segments.  Its boundary
consists of arcs around vertices and of parallels to segments, each cut where another
capsule of the line covers it.  The uncovered pieces are rows; the area is a sum over them
(Green's theorem), and chained end to start they are the outline's rings.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.util import col_of
from .cells import apart, held, segment_band_cells, with_point_cell


def circle_ring(x, y, radius: float, vertices: int = 32) -> Column:
    """A closed ring approximating the circle of `radius` around (x, y)."""
    step = 2.0 * math.pi / vertices
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(vertices)),
        lambda k: F.struct(
            (F.col(x) + F.lit(float(radius)) * F.cos(k.cast("double") * step)).alias("x"),
            (F.col(y) + F.lit(float(radius)) * F.sin(k.cast("double") * step)).alias("y"),
        ),
    )
    # close exactly on the first vertex
    return F.array(F.concat(F.slice(ring, 1, vertices), F.slice(ring, 1, 1)))


def capsule_ring(seg, radius: float, vertices: int = 32) -> Column:
    """A closed ring around one segment (struct x1, y1, x2, y2): a half circle at each
    end, joined by the two parallels.  A segment of length 0 gives a circle."""
    s = col_of(seg)
    heading = F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"])
    half = vertices // 2
    step = math.pi / half

    def arc(x: Column, y: Column, start: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(half)),
            lambda k: F.struct(
                (x + F.lit(float(radius)) * F.cos(start + k.cast("double") * step)).alias("x"),
                (y + F.lit(float(radius)) * F.sin(start + k.cast("double") * step)).alias("y"),
            ),
        )

    ring = F.concat(arc(s["x2"], s["y2"], heading - math.pi / 2), arc(s["x1"], s["y1"], heading + math.pi / 2))
    return F.array(F.concat(ring, F.slice(ring, 1, 1)))


# boundary pieces shorter than this share of the radius are rounding noise
_NOISE = 1e-12
# a chord whose squared half length is below this share of the squared radius is a touch
_TOUCH = 1e-9
# radii between the middle of a side's chunk (at most two radii long) and a segment that can cover part of it
_REACH = 3.0


def _xy(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def _local_segments(rows: DataFrame) -> DataFrame:
    """`(feature_id, ox, oy, x1, y1, x2, y2)`: the distinct segments of every line, ends in
    order and relative to the line's first vertex; single vertices have length 0."""
    first = F.element_at(geom.vertices("parts"), 1)
    each = rows.where(F.size(geom.vertices("parts")) > 0).select(
        "feature_id", first["x"].alias("ox"), first["y"].alias("oy"), F.explode(geom.segments_of("parts")).alias("s")
    )
    each = each.select(
        "feature_id", "ox", "oy", *[(F.col(f"s.{c}") - F.col(f"o{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")]
    ).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e300" for c in ("x1", "y1", "x2", "y2")))
    a, b = _xy("x1", "y1"), _xy("x2", "y2")
    ends = each.select("feature_id", "ox", "oy", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.select("feature_id", "ox", "oy", *[F.col(f"{e}.{c}").alias(f"{c}{n}") for n, e in ((1, "a"), (2, "b")) for c in "xy"]).distinct()


def _boundary_elements(segs: DataFrame, r: float) -> DataFrame:
    """What the boundary of a buffer can consist of: the circle of every distinct vertex
    (`side` 0, parameter: angle 0 to 2 pi) and both sides of every segment (`side` 1 to the
    left, -1 to the right, parameter: metres along it), cut into chunks of at most two radii.
    (`mx`, `my`) is the vertex or the middle of the chunk's part of the segment."""
    ids = ["feature_id", "ox", "oy"]
    ends = segs.select(*ids, F.explode(F.array(_xy("x1", "y1"), _xy("x2", "y2"))).alias("p"))
    circles = ends.select(*ids, F.col("p.x").alias("x1"), F.col("p.y").alias("y1")).distinct()
    circles = circles.select(
        *ids, "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.lit(0).alias("side"), F.lit(0.0).alias("lo"),
        F.lit(2.0 * math.pi).alias("hi"), F.col("x1").alias("mx"), F.col("y1").alias("my"),
    )
    length = geom.distance("x1", "y1", "x2", "y2")
    chunks = segs.withColumn("len", length).where("len > 0").withColumn("n", F.ceil(F.col("len") / F.lit(2.0 * r)))
    chunks = chunks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda k: F.col("len") * (k / F.col("n"))
    mid = (F.col("k") + 0.5) / F.col("n")
    sides = chunks.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        *ids, "x1", "y1", "x2", "y2", "side", at(F.col("k")).alias("lo"), at(F.col("k") + 1).alias("hi"),
        (F.col("x1") + mid * (F.col("x2") - F.col("x1"))).alias("mx"), (F.col("y1") + mid * (F.col("y2") - F.col("y1"))).alias("my"),
    )
    return circles.unionByName(sides)


def _staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """`df` with columns from SQL text, each stage on those before it."""
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df


def _arc_covers(pairs: DataFrame, r: float) -> DataFrame:
    """Pairs of a circle around (`x1`, `y1`) and a segment (`ax`, `ay`, `bx`, `by`), with the
    angles `s` to `e` of the circle that lie in the segment's capsule: one counter-clockwise
    arc, `s` in the first turn; null where there is none."""
    r = float(r)
    return _staged(
        pairs,
        {"dx": "bx - ax", "dy": "by - ay", "px": "x1 - ax", "py": "y1 - ay", "qx": "x1 - bx", "qy": "y1 - by"},
        {"len": "sqrt(dx * dx + dy * dy)", "da": "sqrt(px * px + py * py)", "db": "sqrt(qx * qx + qy * qy)"},
        {"ex": "if(len > 0, dx / len, 1D)", "ey": "if(len > 0, dy / len, 0D)"},
        # the centre along the segment and to its left
        {"u": "px * ex + py * ey", "v": "py * ex - px * ey", "heading": "atan2(ey, ex)"},
        # seen with the centre on the left; hardly off the axis is on it
        {"w": f"if(abs(v) < {0.5 * _TOUCH * r!r}D, 0D, abs(v))"},
        {"rise": f"asin(greatest(-1D, 1D - w / {r!r}D))"},
        {
            "run": f"{r!r}D * cos(rise)",
            # headings (-pi to 0) of the ends from the centre; half the arcs that their discs cover
            "head_a": "atan2(-w, -u)", "half_a": f"acos(least(1D, da / {2 * r!r}D))",
            "head_b": "atan2(-w, len - u)", "half_b": f"acos(least(1D, db / {2 * r!r}D))",
            "gap": "if(u < 0, da, if(u > len, db, w))",
        },
        {
            "right": "if(u + run > len, head_b + half_b, if(u + run < 0, head_a + half_a, rise))",
            "left": "if(u - run < 0, head_a - half_a, if(u - run > len, head_b - half_b, -pi() - rise))",
        },
        # an end of the segment is the centre: exactly the half circle towards the other end
        {
            "own": "CASE WHEN da = 0 AND db = 0 THEN 0 WHEN da = 0 THEN 1 WHEN db = 0 THEN 2 ELSE 3 END",
        },
        {
            "s": f"CASE own WHEN 0 THEN NULL WHEN 1 THEN heading - pi() / 2 WHEN 2 THEN heading + pi() / 2 ELSE if(gap < {2 * r!r}D, heading + if(v >= 0, left, -right), NULL) END",
            "width": "if(own = 3, right - left, pi())",
        },
        {"s": "s - floor(s / (2 * pi())) * (2 * pi())"},
        {"e": "s + width"},
    )


def _within(low: str, high: str, at: str, slope: str) -> tuple[str, str]:
    """SQL of the least and greatest t with low < at + slope * t < high (null: none)."""
    one, two = f"(({low}) - {at}) / {slope}", f"(({high}) - {at}) / {slope}"
    flat, inside = f"abs({slope}) < 1e-14", f"{at} > {low} AND {at} < {high}"
    lo = f"CASE WHEN {flat} THEN if({inside}, double('-infinity'), NULL) ELSE least({one}, {two}) END"
    hi = f"CASE WHEN {flat} THEN if({inside}, double('infinity'), NULL) ELSE greatest({one}, {two}) END"
    return lo, hi


def _side_covers(pairs: DataFrame, r: float) -> DataFrame:
    """Pairs of a chunk of a segment's side and a segment (`ax`, `ay`, `bx`, `by`), with the
    metres `s` to `e` along the chunk's segment where its side lies in the other's capsule.
    The capsule is convex: one stretch, the hull of those in its box and its end discs."""
    r = float(r)
    along = _within("0D", "clen", "t0", "t1")
    across = _within(f"{-r!r}D", f"{r!r}D", "w0", "w1")
    # a disc around an end of the segment itself only touches the side
    chord = lambda x, y, off: f"if(({x} = x1 AND {y} = y1) OR ({x} = x2 AND {y} = y2), 0D, {r * r!r}D - {off} * {off})"
    return _staged(
        pairs,
        {"dx": "x2 - x1", "dy": "y2 - y1", "cx": "bx - ax", "cy": "by - ay"},
        {"len": "sqrt(dx * dx + dy * dy)", "clen": "sqrt(cx * cx + cy * cy)"},
        {"ux": "dx / len", "uy": "dy / len", "ex": "if(clen > 0, cx / clen, 1D)", "ey": "if(clen > 0, cy / clen, 0D)"},
        # the side's start, from both ends of the other segment
        {"fx": f"x1 - side * {r!r}D * uy - ax", "fy": f"y1 + side * {r!r}D * ux - ay"},
        {"gx": "fx - cx", "gy": "fy - cy", "t0": "fx * ex + fy * ey", "t1": "ux * ex + uy * ey", "w0": "fy * ex - fx * ey", "w1": "uy * ex - ux * ey"},
        {"fa": "fx * ux + fy * uy", "oa": "fx * uy - fy * ux", "fb": "gx * ux + gy * uy", "ob": "gx * uy - gy * ux"},
        {"ha": chord("ax", "ay", "oa"), "hb": chord("bx", "by", "ob")},
        {
            "ha": f"if(ha > {_TOUCH * r * r!r}D, sqrt(ha), NULL)", "hb": f"if(hb > {_TOUCH * r * r!r}D, sqrt(hb), NULL)",
            "t_lo": along[0], "t_hi": along[1], "w_lo": across[0], "w_hi": across[1],
        },
        {
            "boxed": "clen > 0 AND t_lo IS NOT NULL AND w_lo IS NOT NULL AND greatest(t_lo, w_lo) < least(t_hi, w_hi)",
            # both sides on one straight line: the smaller segment has it, if the axes lie on one side of it
            "same": f"clen > 0 AND abs(w1) < 1e-9 AND abs(abs(w0 + w1 * (lo + hi) / 2) - {r!r}D) < {_TOUCH * r!r}D",
            "axis": "(my - ay) * ex - (mx - ax) * ey",
            "first": "struct(ax, ay, bx, by) < struct(x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by)",
            "itself": "ax = x1 AND ay = y1 AND bx = x2 AND by = y2",
        },
        # least and greatest skip nulls
        {
            "s": f"CASE WHEN itself THEN NULL WHEN same THEN if(first AND abs(axis) < {r!r}D, t_lo, NULL) "
            "ELSE least(if(boxed, greatest(t_lo, w_lo), NULL), -fa - ha, -fb - hb) END",
            "e": f"CASE WHEN itself THEN NULL WHEN same THEN if(first AND abs(axis) < {r!r}D, t_hi, NULL) "
            "ELSE greatest(if(boxed, least(t_hi, w_hi), NULL), -fa + ha, -fb + hb) END",
        },
    )


def line_buffer_pieces(lines: DataFrame, radius: float) -> DataFrame:
    """The boundary of every line's `radius` buffer as oriented pieces, inside to the left:
    `(feature_id, ox, oy, x1, y1, x2, y2, side, lo, hi)`, coordinates relative to (`ox`, `oy`).

    A piece is an arc of the circle around vertex (`x1`, `y1`) from angle `lo` to `hi`
    (`side` 0), or the stretch `lo` to `hi`, in metres along the segment, of its left (1,
    run backwards) or right (-1) parallel.  The union of a line's capsules is bounded by the
    parts of these that no capsule of the line covers.  Every vertex and chunk of a side is
    keyed by one cell and meets the segments within reach in a sort-merge join on (line, cell);
    each covers one stretch of it, and a running maximum over the stretches leaves the gaps.  The work
    grows with the pairs of a vertex or chunk and a segment of the same line within
    three radii.  Vertices that are null or not finite take no part; repeated segments count
    once; an empty table or a line without vertices gives no pieces.  Where two capsules
    touch along a line from both sides, both stretches are returned and cancel in the area.
    `feature_id` must tell the rows apart (`cells.apart` numbers them).
    """
    r = float(radius)
    segs = _local_segments(lines.select("feature_id", "parts"))
    size = _REACH * r
    elements = with_point_cell(_boundary_elements(segs, r), size, "mx", "my")
    ends = [F.col(c).alias(n) for c, n in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"))]
    covers = segment_band_cells(segs.drop("ox", "oy"), size, size).select("feature_id", "cx", "cy", *ends)
    # pinned to a join that spills: the estimate of an exploded side is too low to broadcast on
    pairs = lambda which: elements.where(which).join(covers.hint("merge"), ["feature_id", "cx", "cy"])
    keys = ["feature_id", "ox", "oy", "x1", "y1", "x2", "y2", "side", "lo", "hi"]
    arcs = _arc_covers(pairs("side = 0"), r)
    # an arc that passes the end of the turn goes on from 0
    stretch = lambda s, e: F.struct(F.expr(s).alias("from"), F.expr(e).alias("to"))
    arcs = arcs.select(*keys, F.explode(F.array(stretch("s", "e"), stretch("if(s IS NULL, NULL, 0D)", "e - 2 * pi()"))).alias("s"))
    sides = _side_covers(pairs("side <> 0"), r).select(*keys, F.explode(F.array(stretch("s", "e"))).alias("s"))
    met = arcs.unionByName(sides).select(*keys, "s.from", "s.to").where(F.col("from") < F.col("to"))
    # the end of the element is a stretch of its own, so the gap before it shows
    stretches = met.unionByName(elements.select(*keys, F.col("hi").alias("from"), F.col("hi").alias("to")))
    before = Window.partitionBy(*keys).orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    gaps = stretches.withColumn("open", F.greatest(F.col("lo"), F.max("to").over(before))).withColumn("close", F.least("from", "hi"))
    noise = F.when(F.col("side") == 0, F.lit(_NOISE)).otherwise(F.lit(_NOISE * r))
    return gaps.where(F.col("close") - F.col("open") > noise).select(*keys[:-2], F.col("open").alias("lo"), F.col("close").alias("hi"))


def _side_point(r: float, t: str) -> tuple[Column, Column]:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / length, dy / length
    return F.col("x1") + F.col(t) * ux - F.col("side") * r * uy, F.col("y1") + F.col(t) * uy + F.col("side") * r * ux


def piece_area(radius: float) -> Column:
    """A piece's part of the enclosed area, by Green's theorem (holes count negative)."""
    r = float(radius)
    turn = F.col("hi") - F.col("lo")
    arc = r * r * turn + r * F.col("x1") * (F.sin("hi") - F.sin("lo")) - r * F.col("y1") * (F.cos("hi") - F.cos("lo"))
    (ax, ay), (bx, by) = _side_point(r, "lo"), _side_point(r, "hi")
    return 0.5 * F.when(F.col("side") == 0, arc).otherwise(-F.col("side") * (ax * by - bx * ay))


def piece_length(radius: float) -> Column:
    turn = F.col("hi") - F.col("lo")
    return F.when(F.col("side") == 0, float(radius) * turn).otherwise(turn)


def buffer_measures(pieces: DataFrame, radius: float) -> DataFrame:
    """`(feature_id, area, perimeter)` of the buffers that `line_buffer_pieces` bounds."""
    return pieces.groupBy("feature_id").agg(F.sum(piece_area(radius)).alias("area"), F.sum(piece_length(radius)).alias("perimeter"))


def line_buffer_area(lines: DataFrame, radius: float) -> DataFrame:
    """`(feature_id, area, perimeter)` of each line's `radius` buffer, exact but for rounding;
    that of a single vertex is a circle.  Every row of `lines` is a line of its own, also
    where rows share a `feature_id` or have none."""
    named = held(apart(lines.select("feature_id", "parts")))
    rows = named.select(F.col("shape").alias("feature_id"), "parts")
    measures = buffer_measures(line_buffer_pieces(rows, radius), radius).withColumnRenamed("feature_id", "shape")
    return measures.join(named.select("shape", "feature_id"), "shape").select("feature_id", "area", "perimeter")


def _chained(starts: np.ndarray, ends: np.ndarray, r: float) -> list[int]:
    """For every piece the one that starts where it ends: the nearest start not yet taken,
    looked for within growing distances (pieces meet up to rounding)."""
    follower = [-1] * len(ends)
    free = set(range(len(starts)))
    for reach in (1e-8 * r, 1e-5 * r, 1e-2 * r, math.inf):
        open_ends = [i for i, f in enumerate(follower) if f < 0]
        grid: dict[tuple[int, int], list[int]] = {}
        cell = (lambda p: (0, 0)) if reach == math.inf else (lambda p: (math.floor(p[0] / reach), math.floor(p[1] / reach)))  # noqa: B023
        for j in free:
            grid.setdefault(cell(starts[j]), []).append(j)
        for i in open_ends:
            gx, gy = cell(ends[i])
            near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in grid.get((gx + dx, gy + dy), ()) if j in free]
            best = min(near, key=lambda j: math.dist(starts[j], ends[i]), default=None)
            if best is not None and math.dist(starts[best], ends[i]) <= reach:
                follower[i] = best
                free.discard(best)
    return follower


def _trace(pieces: pd.DataFrame, r: float, vertices: int) -> list[list[tuple[float, float]]]:
    """The closed rings of one line's boundary pieces, outer ones counter-clockwise and
    first; arcs have a vertex at every multiple of a turn / `vertices`."""
    step = 2.0 * math.pi / vertices
    p = pieces.sort_values(["x1", "y1", "x2", "y2", "side", "lo"])
    rows = list(zip(p.x1, p.y1, p.x2, p.y2, p.side, p.lo, p.hi))

    def at(row, t: float) -> tuple[float, float]:
        x1, y1, x2, y2, side = row[:5]
        if side == 0:
            return x1 + r * math.cos(t), y1 + r * math.sin(t)
        n = math.hypot(x2 - x1, y2 - y1)
        ux, uy = (x2 - x1) / n, (y2 - y1) / n
        return x1 + t * ux - side * r * uy, y1 + t * uy + side * r * ux

    starts = np.array([at(w, w[6] if w[4] == 1 else w[5]) for w in rows])
    ends = np.array([at(w, w[5] if w[4] == 1 else w[6]) for w in rows])
    follower = _chained(starts, ends, r)
    before = {f: i for i, f in enumerate(follower)}
    rings, seen = [], set()
    for first in range(len(rows)):
        ring, i = [], first
        while i not in seen:
            seen.add(i)
            row, last = rows[i], rows[before[i]]
            # chunks of one side go on without a vertex between them
            if row[4] == 0 or row[:5] != last[:5] or before[i] == i:
                ring.append(tuple(starts[i]))
            if row[4] == 0:
                inner = range(math.floor(row[5] / step + 1e-9) + 1, math.ceil(row[6] / step - 1e-9))
                ring += [at(row, m * step) for m in inner]
            i = follower[i]
        if len(ring) > 2:
            rings.append(ring + ring[:1])
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2.0
    # touching sides leave rings without an inside
    return sorted((g for g in rings if abs(area(g)) > 1e-9 * r * r), key=lambda g: -area(g))


def line_buffer_rings(lines: DataFrame, radius: float, vertices: int = 32) -> DataFrame:
    """`(feature_id, kind, parts, area, perimeter)`: the outline of each line's `radius` buffer
    as rings (POLYGON, or MULTIPOLYGON where it falls apart; holes after the outer rings and
    clockwise), with the exact area and length of its true boundary, whose arcs the rings cut
    short at `vertices` a turn.  `shapes.with_wkt` writes it as text.

    Every row is a line of its own, also where rows share a `feature_id` or have none; a
    single vertex gives a circle, a line without vertices no row.  One line's pieces are
    chained by one task, as its vertices were one row before.
    """
    r = float(radius)
    named = held(apart(lines.select("feature_id", "parts")))
    pieces = line_buffer_pieces(named.select(F.col("shape").alias("feature_id"), "parts"), r)
    measured = pieces.withColumns({"area": piece_area(r), "arc": piece_length(r)})

    def outline(group: pd.DataFrame) -> pd.DataFrame:
        ox, oy = group.ox.iloc[0], group.oy.iloc[0]
        rings = [[{"x": float(x + ox), "y": float(y + oy)} for x, y in ring] for ring in _trace(group, r, vertices)]
        turns = [sum((a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy) for a, b in zip(g, g[1:])) for g in rings]
        kind = "MULTIPOLYGON" if sum(t > 0 for t in turns) > 1 else "POLYGON"
        row = [group.feature_id.iloc[0], kind, rings, math.fsum(group.area), math.fsum(group.arc)]
        return pd.DataFrame([row], columns=["shape", "kind", "parts", "area", "perimeter"])

    schema = f"shape long, kind string, parts {geom.PARTS_TYPE}, area double, perimeter double"
    rings = measured.groupBy("feature_id").applyInPandas(outline, schema)
    return rings.join(named.select("shape", "feature_id"), "shape").select("feature_id", "kind", "parts", "area", "perimeter")
