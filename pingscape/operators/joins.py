"""Spatial joins as cell-keyed equi-joins plus an exact residual predicate.

Conventions: the point side has planar columns `x`, `y` (metres in the
projection the caller chose) and an id column; shape sides carry `feature_id`.
Shape coordinates are renamed so they never collide with the point side.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.timefn import MS_PER_DAY, epoch_day
from .cells import DEFAULT_PLAN, JoinPlan, apart, explode_box_cells, fits, held, keyed_join, segment_band_cells, with_point_cell


def within_distance(
    points: DataFrame,
    targets: DataFrame,
    radius: float,
    closed: bool = True,
    plan: JoinPlan = DEFAULT_PLAN,
    cell_size: float | None = None,
) -> DataFrame:
    """Pairs (point, target) with distance <= radius (`closed`) or < radius.

    Targets' `x`, `y` come back as `fx`, `fy`; the distance as `dist`.  Each
    pair appears once.  Bag semantics: duplicate rows on either side give
    duplicate pairs.
    """
    size = float(cell_size or radius)
    t = targets.withColumnsRenamed({"x": "fx", "y": "fy"})
    t = explode_box_cells(t, "fx", "fy", "fx", "fy", size, pad=radius)
    p = with_point_cell(points, size)
    j = keyed_join(p, t, ["cx", "cy"], plan)
    d = geom.distance("x", "y", "fx", "fy")
    j = j.withColumn("dist", d)
    cond = F.col("dist") <= radius if closed else F.col("dist") < radius
    return j.where(cond).drop("cx", "cy")


def segment_cells(lines: DataFrame, radius: float, size: float) -> DataFrame:
    """`(feature_id, line, cx, cy, segs)`: for every cell, the segments of a line that
    come within `radius` of it (cells along each segment's band, see
    `segment_band_cells`).  Built on the (small) line side only.

    `line` numbers the input rows (`apart`), so two rows that share a `feature_id` (or have
    none) stay two lines.  A part with one vertex is a segment of length 0.
    """
    numbered = apart(lines.select("feature_id", geom.segments_of("parts").alias("edges"))).withColumnRenamed("shape", "line")
    segs = numbered.select("feature_id", "line", F.explode("edges").alias("seg")).select(
        "feature_id", "line", "seg", "seg.x1", "seg.y1", "seg.x2", "seg.y2"
    )
    cells = segment_band_cells(segs, radius, size)
    # what the distance test needs of a segment is computed once, here
    dx, dy = F.col("seg.x2") - F.col("seg.x1"), F.col("seg.y2") - F.col("seg.y1")
    ready = F.struct(F.col("seg.x1").alias("x1"), F.col("seg.y1").alias("y1"), dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("len2"))
    # regroups pieces of one input line: a list never exceeds that line's own
    # vertex count, and only segments near the cell are in it
    return cells.groupBy("feature_id", "line", "cx", "cy").agg(F.collect_list(ready).alias("segs"))


def near_lines(
    points: DataFrame,
    lines: DataFrame,
    radius: float,
    plan: JoinPlan = DEFAULT_PLAN,
    cell_size: float | None = None,
) -> DataFrame:
    """(point, line) pairs with point-to-line distance < radius (inside the buffer).

    One row per pair even when several segments are close: the line side has
    one row per (line, cell) holding all its nearby segments, and the residual
    asks whether any of them is within the radius.
    """
    size = float(cell_size or radius)
    per_cell = segment_cells(lines, radius, size)
    p = with_point_cell(points, size)
    j = keyed_join(p, per_cell, ["cx", "cy"], plan)
    near = F.exists("segs", lambda s: geom.ready_segment_distance("x", "y", s) < radius)
    return j.where(near).drop("cx", "cy", "line", "segs")


def _level_lit(levels: list[int], values: dict[int, float]):
    """CASE level WHEN l THEN values[l] ... END with driver-side doubles, so both
    join sides use bit-identical cell sizes."""
    expr = None
    for lv in levels:
        branch = F.lit(float(values[lv]))
        expr = F.when(F.col("level") == lv, branch) if expr is None else expr.when(F.col("level") == lv, branch)
    return expr.otherwise(F.lit(float(values[levels[0]])))


def _cell_of(v, inv):
    return F.coalesce(F.floor(v * inv), F.lit(0).cast("long"))


def _box_side() -> F.Column:
    """Larger side of the shape's box, without a vertex 0."""
    e = geom.envelope("parts")
    return F.coalesce(F.greatest(e["max_x"] - e["min_x"], e["max_y"] - e["min_y"]), F.lit(0.0))


def polygon_levels(polygons: DataFrame, base_size: float, max_cells_per_axis: int = 64) -> DataFrame:
    """The polygons with `level`: 0 unless the polygon's box spans more than
    `max_cells_per_axis` base cells, else the smallest level whose cell
    (base * 2^level) keeps it within that many cells per axis."""
    return polygons.withColumn("level", _level_of(_box_side(), base_size, max_cells_per_axis))


def _polygon_rows(polygons: DataFrame) -> DataFrame:
    """`(feature_id, edges, side, shape)`: polygons as rows of their own, with their sides and larger box side."""
    return apart(polygons.select("feature_id", geom.edges("parts").alias("edges"), _box_side().alias("side")))


def _level_of(side, base_size: float, max_cells_per_axis: int):
    ratio = side / F.lit(float(base_size) * max_cells_per_axis)
    return F.when(ratio <= 1.0, F.lit(0)).otherwise(F.ceil(F.log2(ratio)).cast("int"))


def _spans(polys: DataFrame, size: float, levels: list[int]) -> DataFrame:
    """`polygon_spans` of `(feature_id, level, shape, edges)`."""
    sizes = {lv: float(size) * (2.0 ** lv) for lv in levels}
    cs = _level_lit(levels, sizes)
    inv = _level_lit(levels, {lv: 1.0 / sizes[lv] for lv in levels})
    pad = 1e-6
    margin = cs * (2 * pad)
    each = polys.select("feature_id", "level", "shape", F.explode("edges").alias("e")).select("feature_id", "level", "shape", "e", "e.*")
    low, high = F.least("y1", "y2") - margin, F.greatest("y1", "y2") + margin
    rows = each.withColumn("cy", F.explode(F.sequence(_cell_of(low, inv), _cell_of(high, inv))))
    # the cells of the row that the edge meets: its part between the row's bounds
    ya = F.greatest(F.least("y1", "y2"), F.col("cy").cast("double") * cs - margin)
    yb = F.least(F.greatest("y1", "y2"), (F.col("cy").cast("double") + 1) * cs + margin)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda y: F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), F.col("x1") + (y - F.col("y1")) * (dx / dy)))
    rows = rows.withColumns({"xa": F.when(dy == 0, F.col("x1")).otherwise(at(ya)), "xb": F.when(dy == 0, F.col("x2")).otherwise(at(yb))})
    # interpolation rounds: a margin relative to the coordinates too
    wide = margin + F.greatest(F.abs("x1"), F.abs("x2")) * 1e-12
    met = F.sequence(_cell_of(F.least("xa", "xb") - wide, inv), _cell_of(F.greatest("xa", "xb") + wide, inv))
    rows = rows.groupBy("feature_id", "level", "shape", "cy").agg(F.collect_list("e").alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(met)))).alias("met"))
    span = lambda lo, hi, gap: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(gap).alias("gap"))
    n = F.size("met")
    gaps = F.filter(F.zip_with(F.slice("met", F.lit(1), n - 1), F.slice("met", F.lit(2), n - 1), lambda a, b: span(a + 1, b - 1, True)), lambda s: s["lo"] <= s["hi"])
    parts = rows.withColumn("span", F.explode(F.concat(F.transform("met", lambda c: span(c, c, False)), gaps)))
    # between two cells that edges meet lie only cells wholly inside or wholly outside: one of them decides
    middle = lambda c: (F.col(c).cast("double") + 0.5) * cs
    parts = parts.withColumn("full", F.col("span.gap") & geom.within_polygon(middle("span.lo"), middle("cy"), "edges")).where(~F.col("span.gap") | F.col("full"))
    left = (F.col("span.lo").cast("double") - pad) * cs
    reach = F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left)
    return parts.select(
        "feature_id", "level", F.col("span.lo").alias("cx_lo"), F.col("span.hi").alias("cx_hi"), "cy", "full",
        F.when(F.col("full"), F.array().cast(f"array<{geom.EDGE_TYPE}>")).otherwise(reach).alias("edges"),
    )


def polygon_spans(
    polygons: DataFrame, size: float, max_cells_per_axis: int = 64, levels: list[int] | None = None
) -> DataFrame:
    """`(feature_id, level, cx_lo, cx_hi, cy, full, edges)`: the cells that a polygon meets, at the
    polygon's level (cell side `size * 2^level`), as spans of rows: by scan line.

    Every edge goes to the rows of cells that its y-range meets, and in a row to the
    cells that its part inside the row meets, by plain arithmetic.  The edges of one
    (polygon, row) are gathered, so a polygon with very many vertices is the work of many
    tasks.  A cell that an edge meets is a span of its own, with the row's edges that reach
    its left side: a ray from a point towards +x stays in the point's row, so these decide
    every point of the cell.  Between two such cells no edge passes: the cells there are one
    span, whose parity decides once; outside spans are dropped, inside ones are `full` (their points
    need no test).  So the rows grow with the outline, not with the area.  Cell bounds are widened by
    2e-6 of a cell, so rounding can only add edges to a cell, never lose one.

    Input rows are polygons of their own, whatever their `feature_id`.
    """
    polys = _polygon_rows(polygons).withColumn("level", _level_of(F.col("side"), size, max_cells_per_axis))
    if levels is None:
        levels = sorted(r["level"] for r in polys.select("level").distinct().collect()) or [0]
    return _spans(polys, size, levels)


def unit_cells(spans: DataFrame) -> DataFrame:
    """`(feature_id, level, cx, cy, full, edges)`: every cell of every span."""
    return spans.withColumn("cx", F.explode(F.sequence("cx_lo", "cx_hi"))).select("feature_id", "level", "cx", "cy", "full", "edges")


def polygon_cells(
    polygons: DataFrame, size: float, max_cells_per_axis: int = 64, levels: list[int] | None = None
) -> DataFrame:
    """`(feature_id, level, cx, cy, full, edges)` for every cell that a polygon meets (see `polygon_spans`)."""
    return unit_cells(polygon_spans(polygons, size, max_cells_per_axis, levels))


# lengths of the aligned runs that a span is cut into, as powers of two
RUNS = (0, 2, 4)


def span_runs(spans: DataFrame, runs: tuple[int, ...] = RUNS) -> DataFrame:
    """`(feature_id, level, run, cx, cy, full, edges)`: every span as the fewest aligned runs of 2^run cells.

    Run b of size 2^k holds the cells b * 2^k to (b + 1) * 2^k - 1; a point meets it by
    `cell >> k`.  Of each size a span has some runs at either end that no larger one
    holds, and of the largest size all that fit.
    """
    lo, hi = F.col("cx_lo"), F.col("cx_hi")
    first = lambda k: F.shiftright(lo + ((1 << k) - 1), k)
    last = lambda k: F.shiftright(hi + 1, k) - 1
    entry = lambda k: lambda b: F.struct(F.lit(k).alias("run"), b.alias("cx"))

    def outermost(k: int, above: int):
        parent = lambda b: F.shiftright(b, above - k)
        return lambda b: (b >= first(k)) & (b <= last(k)) & ~((parent(b) >= first(above)) & (parent(b) <= last(above)))

    pieces = []
    for k, above in zip(runs, [*runs[1:], None], strict=True):
        fit = F.when(first(k) <= last(k), F.sequence(first(k), last(k))).otherwise(F.array().cast("array<long>"))
        if above is not None:
            ends = F.array_distinct(F.array(*[f for i in range((1 << (above - k)) - 1) for f in (first(k) + i, last(k) - i)]))
            fit = F.filter(ends, outermost(k, above))
        pieces.append(F.transform(fit, entry(k)))
    cut = spans.withColumn("r", F.explode(F.concat(*pieces)))
    return cut.select("feature_id", "level", F.col("r.run").alias("run"), F.col("r.cx").alias("cx"), "cy", "full", "edges")


# cells of a typical polygon per axis: most of its points then fall in cells
# that lie wholly inside, and need no edge test
CELLS_PER_POLYGON = 12


def polygon_sides(polygons: DataFrame) -> tuple[float, float]:
    """(median, largest) of the polygons' larger box side, in one small aggregate."""
    r = polygons.select(_box_side().alias("side")).agg(F.percentile_approx("side", 0.5).alias("m"), F.max("side").alias("x")).first()
    med = float(r["m"]) if r["m"] and r["m"] > 0 else 1.0
    return med, float(r["x"] or 0.0)


def auto_cell_size(polygons: DataFrame) -> float:
    """A CELLS_PER_POLYGON-th of the median of the polygons' larger box side."""
    return polygon_sides(polygons)[0] / CELLS_PER_POLYGON


def _held_spans(polygons: DataFrame, cell_size: float | None, max_cells_per_axis: int) -> tuple[DataFrame, list[int], float]:
    """The polygons' spans, built once, with their levels and the side of a base cell."""
    polys = held(_polygon_rows(polygons))
    r = polys.agg(F.percentile_approx("side", 0.5).alias("m"), F.max("side").alias("x")).first()
    median, largest = (float(r["m"]) if r["m"] and r["m"] > 0 else 1.0), float(r["x"] or 0.0)
    size = float(cell_size or median / CELLS_PER_POLYGON)
    polys = polys.withColumn("level", _level_of(F.col("side"), size, max_cells_per_axis))
    if largest <= size * max_cells_per_axis:
        levels = [0]  # every polygon fits the base level: no levels job
    else:
        levels = sorted(r["level"] for r in polys.select("level").distinct().collect()) or [0]
    spans = held(_spans(polys, size, levels))
    return spans, levels, size


def _at_levels(points: DataFrame, keys: list[dict]) -> DataFrame:
    """The points once for each of `keys`, with its columns."""
    key = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in each.items()]) for each in keys]))
    return points.withColumn("key", key).select(*[F.col(f"`{c}`") for c in points.columns], "key.*")


def in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    cell_size: float | None = None,
    plan: JoinPlan = DEFAULT_PLAN,
    max_cells_per_axis: int = 64,
) -> DataFrame:
    """(point, polygon) pairs with the point strictly inside (boundary excluded).

    Overlapping polygons each get their pair.  Holes and multi-polygons follow
    from the crossing parity over all rings.  Polygons far larger than the
    typical one sit on coarser cell levels.  Polygons are cut into spans of rows once, by many tasks (see
    `polygon_spans`).  Where the spans, as aligned runs, pass the size check, they are
    broadcast and every point probes once per level and length of run; else the spans'
    cells meet the points in a sort-merge join, each point keyed once per level.
    """
    spans, levels, size = _held_spans(polygons, cell_size, max_cells_per_axis)
    runs = span_runs(spans)
    inv = _level_lit(levels, {lv: 1.0 / (size * (2.0 ** lv)) for lv in levels})
    at_level = lambda keys: _at_levels(points, keys)
    if plan.force == "broadcast" or plan.force is None and fits(runs, plan.max_broadcast_rows, plan.max_broadcast_bytes):
        # a probe for each length of run: the shape side stays as small as the outlines
        p = at_level([{"level": lv, "run": k} for lv in levels for k in RUNS]).withColumns({"cx": _cell_of(F.col("x"), inv), "cy": _cell_of(F.col("y"), inv)})
        p = p.withColumn("cx", F.expr("shiftright(cx, run)"))
        j = keyed_join(p, runs, ["level", "run", "cx", "cy"], replace(plan, force="broadcast")).drop("run")
    else:
        # shuffled once: points by their own cell
        p = at_level([{"level": lv} for lv in levels]).withColumns({"cx": _cell_of(F.col("x"), inv), "cy": _cell_of(F.col("y"), inv)})
        j = keyed_join(p, unit_cells(spans), ["level", "cx", "cy"], replace(plan, force="shuffle"))
    return j.where(F.col("full") | geom.within_polygon("x", "y", "edges")).drop("level", "cx", "cy", "full", "edges")


# positions and polygons of one cell that are compared as one row
CELL_POSITIONS, CELL_POLYGONS = 256, 32
EDGES_AT_ONCE = 4096


def count_in_polygons(
    positions: DataFrame, polygons: DataFrame, cell_size: float | None = None, plan: JoinPlan = DEFAULT_PLAN, max_cells_per_axis: int = 64
) -> DataFrame:
    """`(feature_id, n, n_distinct)`: per polygon the summed `weight` and the number of the positions
    `(x, y, weight)` strictly inside it; as the pairs of `in_polygons` counted, without making them.

    Every polygon has a `feature_id` of its own.  Cells wholly inside a polygon take the counts of
    their positions, by aligned runs.  In cells that an edge meets, positions and polygons are gathered
    to rows of bounded length, every row of positions meets every row of polygons of its cell, and a
    task compares the two as arrays.
    """
    spans, levels, size = _held_spans(polygons, cell_size, max_cells_per_axis)
    keys = ["level", "cx", "cy"]
    inv = _level_lit(levels, {lv: 1.0 / (size * (2.0 ** lv)) for lv in levels})
    placed = _at_levels(positions, [{"level": lv} for lv in levels]).withColumns({"cx": _cell_of(F.col("x"), inv), "cy": _cell_of(F.col("y"), inv)})
    cells = held(placed.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("positions")))

    run = F.explode(F.array(*[F.lit(k) for k in RUNS]))
    by_run = cells.withColumn("run", run).groupBy("level", "run", F.expr("shiftright(cx, run)").alias("cx"), "cy").agg(F.sum("weight").alias("weight"), F.sum("positions").alias("positions"))
    runs = span_runs(spans.where("full")).select("feature_id", "level", "run", "cx", "cy")
    whole = keyed_join(runs, by_run, ["level", "run", "cx", "cy"], plan).select("feature_id", "weight", "positions")

    pieces = spans.where(~F.col("full") & (F.size("edges") > 0)).select("feature_id", "level", F.col("cx_lo").alias("cx"), "cy", "edges")
    parts = lambda c, most: F.ceil(F.col(c) / F.lit(most)).alias(c)
    met = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("polygons")).join(cells, keys)
    met = held(met.select(*keys, parts("positions", CELL_POSITIONS), parts("polygons", CELL_POLYGONS)))
    dealt = lambda df, c, *of: keyed_join(df, met.select(*keys, c), keys, plan).groupBy(*keys, F.pmod(F.xxhash64(*of), F.col(c)).alias("part"))
    each = lambda c, f: F.transform("rows", lambda r: r[f]).alias(c)
    some = dealt(placed, "positions", "x", "y").agg(F.collect_list(F.struct("x", "y", "weight")).alias("rows"))
    some = some.select(*keys, each("x", "x"), each("y", "y"), each("w", "weight"))
    shapes = dealt(pieces, "polygons", "feature_id").agg(F.collect_list(F.struct("feature_id", "edges")).alias("rows"))
    edges = F.flatten(F.transform("rows", lambda r: r["edges"]))
    coordinate = lambda c: F.transform(edges, lambda e: e[c]).alias(c)
    shapes = shapes.select(*keys, each("ids", "feature_id"), F.transform("rows", lambda r: F.size(r["edges"])).alias("sizes"), *[coordinate(c) for c in ("x1", "y1", "x2", "y2")])
    both = some.join(shapes.hint("merge"), keys).drop(*keys)
    id_type = polygons.schema["feature_id"].dataType.simpleString()
    along = both.mapInArrow(_count_rows, f"feature_id {id_type}, weight long, positions long")
    out = whole.unionByName(along).groupBy("feature_id").agg(F.sum("weight").alias("n"), F.sum("positions").alias("n_distinct"))
    return out


def _count_rows(batches):
    """Rows of positions and polygons of one cell: weight and number of the positions inside each polygon
    (the arithmetic of `geom.within_polygon`)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        split = {}
        for name in ("x", "y", "w", "sizes", "x1", "y1", "x2", "y2"):
            column = batch.column(name)
            bounds = column.offsets.to_numpy()
            split[name] = (column.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0])
        ids, weights, counts = batch.column("ids").flatten(), [], []
        for i in range(batch.num_rows):
            x, y, w, sizes, x1, y1, x2, y2 = (v[b[i] : b[i + 1]] for v, b in split.values())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            crossed, on_edge = np.zeros((len(sizes), len(x)), np.int32), np.zeros((len(sizes), len(x)), bool)
            # some edges at a time: a polygon may have very many in a cell
            for k in range(0, len(owner), EDGES_AT_ONCE):
                mine = owner[k : k + EDGES_AT_ONCE]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                ax, ay, bx, by = (v[k : k + EDGES_AT_ONCE, None] for v in (x1, y1, x2, y2))
                dx, dy, up = bx - ax, by - ay, y - ay
                with np.errstate(divide="ignore", invalid="ignore"):
                    crosses = ((ay > y) != (by > y)) & (x < dx * up / dy + ax)
                crossed[mine[first]] += np.add.reduceat(crosses, first, axis=0, dtype=np.int32)
                on = dx * up - dy * (x - ax) == 0
                if on.any():
                    on &= (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
                    on_edge[mine[first]] |= np.logical_or.reduceat(on, first, axis=0)
            inside = (crossed % 2 == 1) & ~on_edge
            weights.append(inside @ w)
            counts.append(inside.sum(axis=1))
        if weights:
            n, m = np.concatenate(weights), np.concatenate(counts)
            some = m > 0
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(some)), pa.array(n[some], pa.int64()), pa.array(m[some], pa.int64())], ["feature_id", "weight", "positions"])


def case_exposure(
    pings: DataFrame,
    poi_case_pairs: DataFrame,
    radius: float,
    days: int = 10,
    offset_ms: int = 0,
    plan: JoinPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Pings near a POI that is near a case, within +-`days` of the case date.

    `poi_case_pairs`: `(feature_id, px, py, case_date[, n_cases])` - a row per POI and
    case, or per POI, place and date of `n_cases` cases.
    A ping matches a pair when it is within `radius` of the POI and its time is
    in the closed range [midnight(case_date) - days, midnight + days].  Returns
    the matching pings with `feature_id`, the ping's local `day` (epoch days)
    and `weight` = the number of pairs it matches for that POI (bag semantics:
    a ping near a POI matched by k cases counts k times).

    Time is aggregated before the join.  Case dates are whole days, so the pairs
    collapse to (POI, case day, multiplicity).  For a ping on day d the window
    of a case on day c holds the whole day when c - days <= d <= c + days - 1,
    and only the exact midnight when d = c + days.  Each (POI, day) row carries
    both weights, so the shape side is at most POIs x window days x cells, no
    matter how many cases there are, and the join key includes the day.
    """
    size = float(radius)
    c = F.unix_date(F.col("case_date").cast("date"))
    per_day = poi_case_pairs.groupBy("feature_id", "px", "py", c.alias("case_day")).agg(F.sum("n_cases" if "n_cases" in poi_case_pairs.columns else F.lit(1)).alias("mult"))
    spread = per_day.withColumn(
        "day", F.explode(F.sequence(F.col("case_day") - days, F.col("case_day") + days))
    )
    last = F.col("case_day") + days
    t = spread.groupBy("feature_id", "px", "py", "day").agg(
        F.sum(F.when(F.col("day") < last, F.col("mult")).otherwise(F.lit(0))).alias("w_full"),
        F.sum(F.when(F.col("day") == last, F.col("mult")).otherwise(F.lit(0))).alias("w_midnight"),
    )
    t = t.withColumnsRenamed({"px": "fx", "py": "fy"})
    t = explode_box_cells(t, "fx", "fy", "fx", "fy", size, pad=radius)
    p = with_point_cell(pings.withColumn("day", epoch_day("sys_time", offset_ms)), size)
    j = keyed_join(p, t, ["cx", "cy", "day"], plan)
    at_midnight = F.pmod(F.col("sys_time") + F.lit(int(offset_ms)), F.lit(MS_PER_DAY)) == 0
    weight = F.col("w_full") + F.when(at_midnight, F.col("w_midnight")).otherwise(F.lit(0).cast("long"))
    d = geom.distance("x", "y", "fx", "fy")
    hits = j.where(d <= radius).withColumn("weight", weight).where(F.col("weight") > 0)
    return hits.drop("cx", "cy", "fx", "fy", "w_full", "w_midnight")


def exposed_pois(pois: DataFrame, cases: DataFrame, radius2: float, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """`(feature_id, px, py, case_date, n_cases)`: POIs within `radius2` of a place with
    cases.  Cases at one place and date are one row before the join."""
    places = cases.groupBy("x", "y", "case_date").agg(F.count(F.lit(1)).alias("n_cases"))
    pairs = within_distance(pois, places, radius2, closed=True, plan=plan)
    return pairs.select("feature_id", F.col("x").alias("px"), F.col("y").alias("py"), "case_date", "n_cases")


def exposure_by_day(
    pings: DataFrame,
    pois: DataFrame,
    cases: DataFrame,
    radius: float,
    radius2: float,
    days: int = 10,
    offset_ms: int = 0,
    study_area=None,
    plan: JoinPlan = DEFAULT_PLAN,
) -> DataFrame:
    """The double join, composed: POIs within `radius2` of a case, then pings
    within `radius` of those POIs and +-`days` of the case date, counted per
    (POI, ping day).  `pings (ping_id, sys_time, x, y)`, `pois (feature_id, x, y)`,
    `cases (case_id, case_date, x, y)`, all planar; `study_area` an optional
    lng/lat rectangle (Mercator pings) applied to the pings first."""
    from .filters import within_study_area

    if study_area is not None:
        pings = within_study_area(pings, study_area)
    pairs = exposed_pois(pois, cases, radius2, plan)
    hits = case_exposure(pings, pairs, radius, days, offset_ms, plan)
    return hits.groupBy("feature_id", F.date_from_unix_date("day").alias("day")).agg(F.sum("weight").alias("join_count"))
