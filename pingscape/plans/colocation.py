"""Co-location analyses: pings near POIs, roads and inside zones, per feature
and day; window statistics and rankings; the case-exposure double join; the
hourly grid.  Each function takes `(spark, sf_dir)` and returns a lazy
DataFrame over the whole input tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.timefn import (
    MS_PER_DAY,
    date_bounds,
    day_of,
    day_slices,
    hour_slices,
    local_timestamp,
    second_bounds,
    timestamp_text,
)
from ..operators import aggregate, filters, joins
from ..operators.cells import DEFAULT_PLAN, JoinPlan
from ..sources import fixtures
from . import inputs
from . import params as P


# ---------------------------------------------------------------------------
# POIs
# ---------------------------------------------------------------------------
def poi_visits_by_day(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings within `POI_RADIUS` (boundary counts) of each POI, per POI and day.

    Date-cut open time range; the study-area filter is *not* applied (the
    analysis counts every ping in range).  Ordered by day.
    """
    window = date_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = filters.in_date_range(
        inputs.only(inputs.pings_mercator(spark, sf_dir, window), "ping_id", "sys_time", "x", "y"),
        P.FROM_TIME,
        P.TO_TIME,
        P.OFFSET_MS,
    )
    pairs = joins.within_distance(
        pings, inputs.pois_mercator(spark, sf_dir), P.POI_RADIUS, closed=True, plan=plan
    )
    out = aggregate.count_by_day(pairs, "feature_id", "join_count", P.OFFSET_MS)
    return out.orderBy("day", "feature_id")


def _poi_windows(spark: SparkSession, sf_dir: str, plan: JoinPlan) -> DataFrame:
    """Per POI circle (radius `POI_RADIUS`, boundary excluded): n, n_distinct,
    area = pi r^2 and density = n_distinct / area.  All pings, no time filter."""
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir), "x", "y")
    near = lambda p, t: joins.within_distance(p, t, P.POI_RADIUS, closed=False, plan=plan)
    stats = aggregate.stats_per_window(pings, inputs.pois_mercator(spark, sf_dir), near)
    return aggregate.with_density(stats, F.lit(P.POI_RADIUS) * F.lit(P.POI_RADIUS) * F.pi())


def poi_window_stats(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """All matched windows by density, descending (ties by feature id)."""
    return _poi_windows(spark, sf_dir, plan).orderBy(F.col("density").desc(), "feature_id")


def matched_windows(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Number of windows with at least one point (one row)."""
    return _poi_windows(spark, sf_dir, plan).agg(F.count(F.lit(1)).alias("n_windows"))


def _with_circle_wkt(spark: SparkSession, sf_dir: str, top: DataFrame) -> DataFrame:
    """The ranked windows with their circle as WKT text (millimetres): at most FIRST_X rows are joined."""
    from ..operators.shapes import circle_rings, with_wkt

    rings = with_wkt(circle_rings(inputs.pois_mercator(spark, sf_dir), P.POI_RADIUS), decimals=3)
    # the ranking has at most FIRST_X rows, a fixed number
    return rings.select("feature_id", "wkt").join(F.broadcast(top), "feature_id")


def top_poi_by_density(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """The `FIRST_X` densest windows: window text, set size, density."""
    top = aggregate.top_windows(_poi_windows(spark, sf_dir, plan), P.FIRST_X, "density")
    return _with_circle_wkt(spark, sf_dir, top).select("feature_id", "wkt", "n_distinct", "density").orderBy(F.col("density").desc(), "feature_id")


def top_poi_by_count(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """The `FIRST_X` windows with the most distinct points, with the window text."""
    top = aggregate.top_windows(_poi_windows(spark, sf_dir, plan), P.FIRST_X, "n_distinct")
    return _with_circle_wkt(spark, sf_dir, top).select("feature_id", "wkt", "n_distinct").orderBy(F.col("n_distinct").desc(), "feature_id")


def poi_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every POI's circle as a polygon: text, vertices, area of the ring."""
    from ..operators.shapes import circle_rings, with_wkt

    rings = with_wkt(circle_rings(inputs.pois_mercator(spark, sf_dir), P.POI_RADIUS), decimals=3)
    return rings.select("feature_id", "wkt", F.size(geom.vertices("parts")).alias("n_vertices"), F.round(geom.polygon_area("parts"), 3).alias("area"))


# ---------------------------------------------------------------------------
# cases (double join)
# ---------------------------------------------------------------------------
def _poi_case_pairs(spark: SparkSession, sf_dir: str, plan: JoinPlan) -> DataFrame:
    pois = inputs.pois_mercator(spark, sf_dir)
    cases = inputs.cases_mercator(spark, sf_dir)
    pairs = joins.within_distance(pois, cases, P.CASE_RADIUS, closed=True, plan=plan)
    return pairs.select("feature_id", F.col("x").alias("px"), F.col("y").alias("py"), "case_id", "case_date")


def pois_near_cases(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """POI / infected-place pairs within `CASE_RADIUS`, with the case date."""
    return _poi_case_pairs(spark, sf_dir, plan).select("feature_id", "case_id", "case_date")


def case_exposure_by_day(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings within `EXPOSURE_RADIUS` of a POI near a case and within
    +-`EXPOSURE_DAYS` of the case date, per (POI, ping day).  Pings restricted
    to the date-cut range and the study area.  A ping near a POI matched by k
    cases counts k times."""
    window = date_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir, window), "ping_id", "sys_time", "x", "y")
    pings = filters.within_study_area(filters.in_date_range(pings, P.FROM_TIME, P.TO_TIME, P.OFFSET_MS))
    hits = joins.case_exposure(
        pings,
        joins.exposed_pois(inputs.pois_mercator(spark, sf_dir), inputs.cases_mercator(spark, sf_dir), P.CASE_RADIUS, plan),
        P.EXPOSURE_RADIUS, P.EXPOSURE_DAYS, P.OFFSET_MS, plan
    )
    out = hits.groupBy("feature_id", F.date_from_unix_date("day").alias("day")).agg(
        F.sum("weight").alias("join_count")
    )
    return out.orderBy("day", "feature_id")


# ---------------------------------------------------------------------------
# zones (polygons)
# ---------------------------------------------------------------------------
def zone_counts_by_day(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Fishnet counts: pings (UTM 50N) strictly inside each zone, one result per
    whole day from midnight of the start date.  Day slices are open, so pings at
    exactly midnight are dropped; all days come from one scan and one group-by."""
    lo, hi = day_slices(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_utm(spark, sf_dir, (lo, hi)), "ping_id", "sys_time", "x", "y")
    pings = filters.off_slice_edges(filters.open_range(pings, lo, hi), MS_PER_DAY, P.OFFSET_MS)
    pairs = joins.in_polygons(pings, inputs.zones_utm(spark, sf_dir), plan=plan)
    return pairs.groupBy(day_of("sys_time", P.OFFSET_MS).alias("day"), "feature_id").agg(
        F.count(F.lit(1)).alias("join_count")
    )


def zone_totals(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Per zone over the whole (second-precision) range: `n` pairs and
    `n_distinct` distinct positions (the set size)."""
    window = second_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_utm(spark, sf_dir, window), "ping_id", "sys_time", "x", "y")
    pings = filters.in_time_range(pings, P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    return aggregate.stats_per_window(pings, inputs.zones_utm(spark, sf_dir), lambda p, t: joins.in_polygons(p, t, plan=plan), count=lambda p, t: joins.count_in_polygons(p, t, plan=plan))


def block_totals(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings inside multi-polygons with holes and of very different sizes, per polygon."""
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir), "x", "y")
    return aggregate.stats_per_window(pings, inputs.blocks_mercator(spark, sf_dir), lambda p, t: joins.in_polygons(p, t, plan=plan), count=lambda p, t: joins.count_in_polygons(p, t, plan=plan))


def shape_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-polygons with holes written as text, read back and measured: kind, rings, members, area."""
    from ..operators.nesting import polygon_measures

    shapes = inputs.blocks_mercator(spark, sf_dir)
    text = shapes.select("feature_id", geom.to_wkt("kind", "parts").alias("wkt"))
    back = text.select("feature_id", geom.wkt_kind("wkt").alias("kind"), geom.wkt_parts("wkt").alias("parts"))
    return polygon_measures(back).withColumn("area", F.round("area", 2))


def ring_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ring of the multi-polygons: how many rings surround it, the smallest of them, its area."""
    from ..operators.nesting import ring_nesting

    nested = ring_nesting(inputs.blocks_mercator(spark, sf_dir))
    return nested.select("feature_id", "ring", "depth", "parent", F.round("area", 2).alias("area"))


def labeled_zone_hour8(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings (Mercator) inside labelled zones at local hour 8, per day.  Date-cut
    range; a ping inside two overlapping zones counts twice."""
    window = date_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir, window), "ping_id", "sys_time", "x", "y")
    pings = filters.at_hour(filters.in_date_range(pings, P.FROM_TIME, P.TO_TIME, P.OFFSET_MS), P.MORNING_HOUR, P.OFFSET_MS)
    pairs = joins.in_polygons(pings, inputs.zones_mercator(spark, sf_dir), plan=plan)
    out = pairs.groupBy(day_of("sys_time", P.OFFSET_MS).alias("day")).agg(F.count(F.lit(1)).alias("join_count"))
    return out.orderBy("day")


# ---------------------------------------------------------------------------
# roads (lines)
# ---------------------------------------------------------------------------
def road_pings(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings strictly nearer than `ROAD_RADIUS` to each road (all pings):
    `n` distinct pings, `n_distinct` distinct positions."""
    return _line_windows(spark, sf_dir, inputs.roads_mercator(spark, sf_dir), plan)


def _line_windows(spark: SparkSession, sf_dir: str, lines: DataFrame, plan: JoinPlan) -> DataFrame:
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir), "x", "y")
    return aggregate.stats_per_window(pings, lines, lambda p, t: joins.near_lines(p, t, P.ROAD_RADIUS, plan=plan))


def road_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads (Mercator) as WKT text with millimetre decimals, ordered by the text."""
    from ..operators.shapes import with_wkt

    return with_wkt(inputs.roads_mercator(spark, sf_dir), decimals=3).select("feature_id", "wkt").orderBy("wkt")


def road_window_stats(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Per road buffer: `n`, `n_distinct`, the exact buffer `area` (to 0.01 m2) and
    `density = n_distinct / area`, densest first."""
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir), "x", "y")
    return line_window_stats(pings, inputs.roads_mercator(spark, sf_dir), P.ROAD_RADIUS, plan)


def line_window_stats(pings: DataFrame, lines: DataFrame, radius: float, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """`(feature_id, n, n_distinct, area, density)` of every line with a ping in its buffer, densest first.

    Every row of `lines` is a window of its own, also where rows share an id, have
    none, or hold a single vertex."""
    from ..operators.buffers import buffer_measures, line_buffer_pieces
    from ..operators.cells import apart, held

    # windows by row number; the names come back at the end
    named = held(apart(lines.select("feature_id", "parts")))
    rows = named.select(F.col("shape").alias("feature_id"), "parts")
    stats = aggregate.stats_per_window(pings, rows, lambda p, t: joins.near_lines(p, t, radius, plan=plan))
    area = buffer_measures(line_buffer_pieces(rows, radius), radius).select("feature_id", F.round("area", 2).alias("area"))
    # both sides are aggregates keyed by the row number, so they are already
    # partitioned on the join key: a shuffled hash join adds no exchange
    out = stats.join(area.hint("shuffle_hash"), "feature_id").withColumn("density", F.col("n_distinct") / F.col("area"))
    out = out.withColumnRenamed("feature_id", "shape").join(named.select("shape", "feature_id"), "shape")
    return out.select("feature_id", "n", "n_distinct", "area", "density").orderBy(F.col("density").desc(), "feature_id")


def road_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `ROAD_RADIUS` buffer of every wide road (one road per supplier) as an outline: its
    exact area and perimeter, and the vertices and area of its rings."""
    from ..operators.buffers import line_buffer_rings

    rings = line_buffer_rings(inputs.wide_roads_mercator(spark, sf_dir), P.ROAD_RADIUS)
    return rings.select(
        "feature_id", F.round("area", 2).alias("area"), F.round("perimeter", 3).alias("perimeter"),
        (F.size(geom.vertices("parts")) - F.size("parts")).cast("long").alias("n_vertices"),
        F.round(geom.polygon_area("parts"), 0).alias("outline_area"),
    )


def top_road_by_density(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """The `FIRST_X` road buffers with the most distinct points per square metre."""
    top = aggregate.top_windows(road_window_stats(spark, sf_dir, plan), P.FIRST_X, "density")
    return top.select("feature_id", "n_distinct", "density")


def road_visits_by_day(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings inside each road buffer per (road, day), second-precision range,
    ordered by day then road."""
    window = second_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir, window), "ping_id", "sys_time", "x", "y")
    pings = filters.in_time_range(pings, P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pairs = joins.near_lines(pings, inputs.roads_mercator(spark, sf_dir), P.ROAD_RADIUS, plan=plan)
    out = aggregate.count_by_day(pairs, "feature_id", "join_count", P.OFFSET_MS)
    return out.orderBy("day", "feature_id")


def road_visits_unordered(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """The same counts without the final ordering (no range shuffle)."""
    window = second_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir, window), "ping_id", "sys_time", "x", "y")
    pings = filters.in_time_range(pings, P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pairs = joins.near_lines(pings, inputs.roads_mercator(spark, sf_dir), P.ROAD_RADIUS, plan=plan)
    return aggregate.count_by_day(pairs, "feature_id", "join_count", P.OFFSET_MS)


def road_visits_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings near the wide roads per (road, day), as SQL over the registered functions: the
    roads' cells come from `shape_cells`, so the join is one on cell numbers."""
    window = second_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir, window), "ping_id", "sys_time", "x", "y")
    pings = filters.in_time_range(pings, P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    pings = pings.select("x", "y", day_of("sys_time", P.OFFSET_MS).alias("day"))
    return line_visits_sql(pings, inputs.wide_roads_mercator(spark, sf_dir), P.ROAD_RADIUS)


# points of a typical smallest cell: fewer cost more cells, more cost comparisons
LEAF_POINTS = 32
# halvings of the cell side: 2^-8 of the radius is the smallest
MAX_HALVINGS = 8


def line_visits_sql(points: DataFrame, lines: DataFrame, radius: float, halvings: int | None = None) -> DataFrame:
    """`(feature_id, day, join_count)`: points `(x, y, day)` strictly nearer than `radius` to each line.

    A line's cells (side `radius`) that hold points are halved `halvings` times where the buffer's
    edge passes.  A cell inside the buffer takes the counts per day of its whole cell; points are
    compared only in the smallest cells along the edge.  The halvings follow the points of a cell, so
    the comparisons of a line grow with the root of the points, not with the points in its buffer.
    """
    from ..functions.sql import register_sql_functions
    from ..operators.cells import DEFAULT_PLAN

    spark = points.sparkSession
    register_sql_functions(spark)
    r = f"{float(radius)}D"
    points = points.where("NOT isnan(x) AND NOT isnan(y)")
    lines = lines.select("feature_id", "parts").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = spark.sql(f"SELECT cell_of(x, {r}) AS cx, cell_of(y, {r}) AS cy, count(*) AS n FROM {{points}} GROUP BY 1, 2", points=points)
    met = held.agg(F.count(F.lit(1)).alias("cells"), (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("n")).first()
    if halvings is None:
        # the cell that a point typically shares, so that crowded cells count
        halvings = min(MAX_HALVINGS, max(0, math.ceil(math.log((met["n"] or 1.0) / LEAF_POINTS, 4))))
    side = lambda level: f"{float(radius) / 2**level!r}D"
    # only counted cells are broadcast; the estimate of an exploded side is no bound
    small = met["cells"] <= DEFAULT_PLAN.max_broadcast_rows // 4
    chain = ",\n".join(f"cells_{k + 1} AS (SELECT feature_id, q AS c FROM (SELECT feature_id, cell_quarters(c, {side(k)}, {r}) AS quarters FROM cells_{k}) LATERAL VIEW OUTER explode(quarters) t AS q)" for k in range(halvings))
    levels = [f"SELECT {k} AS level, cell_of(x, {side(k)}) AS cx, cell_of(y, {side(k)}) AS cy, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, day, count(*) AS n FROM {{points}} GROUP BY 1, 2, 3, 6" for k in range(halvings)]
    levels.append(f"SELECT {halvings} AS level, cell_of(x, {side(halvings)}) AS cx, cell_of(y, {side(halvings)}) AS cy, x, y, day, CAST(1 AS BIGINT) AS n FROM {{points}}")
    return spark.sql(
        f"""WITH line_cells AS (
  SELECT feature_id, edges, cx, cy FROM (SELECT feature_id, shape_edges(parts) AS edges, shape_cells(parts, {r}, {r}) AS cells FROM {{lines}}) LATERAL VIEW OUTER inline(cells) t AS cx, cy),
cells_0 AS (
  SELECT /*+ {"BROADCAST" if small else "MERGE"}(h) */ feature_id, shape_cell(l.cx, l.cy, {r}, {r}, edges) AS c
  FROM line_cells l LEFT SEMI JOIN {{held}} h ON l.cx = h.cx AND l.cy = h.cy){"," if chain else ""}
{chain},
road_cells AS (SELECT feature_id, c.level AS level, c.cx AS cx, c.cy AS cy, c.inside AS inside, c.edges AS edges FROM cells_{halvings} WHERE c.inside OR size(c.edges) > 0),
counted AS ({" UNION ALL ".join(levels)})
SELECT /*+ MERGE(s) */ feature_id, day, sum(n) AS join_count
FROM counted p JOIN road_cells s ON p.level = s.level AND p.cx = s.cx AND p.cy = s.cy
WHERE inside OR edges_near(x, y, {r}, edges) GROUP BY feature_id, day""".replace("\n,\nroad_cells", ",\nroad_cells"),
        lines=lines, points=points, held=held,
    )


def segment_capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `ROAD_RADIUS` buffer of every road segment as a ring (a capsule): text-free
    summary of its vertices and area."""
    return _capsules(inputs.roads_mercator(spark, sf_dir))


def wide_segment_capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rings around the segments of the wide roads, one road per supplier."""
    return _capsules(inputs.wide_roads_mercator(spark, sf_dir))


def _capsules(roads: DataFrame) -> DataFrame:
    from ..operators.buffers import capsule_ring

    segs = roads.select("feature_id", F.posexplode(geom.edges("parts")).alias("seg_idx", "s"))
    rings = segs.withColumn("parts", capsule_ring("s", P.ROAD_RADIUS))
    e = geom.envelope("parts")
    return rings.select(
        "feature_id", "seg_idx", F.size(geom.vertices("parts")).alias("n_vertices"), F.round(geom.polygon_area("parts"), 2).alias("area"),
        *[F.round(e[c], 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")],
    )


def road_visits_by_text_id(spark: SparkSession, sf_dir: str, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pings near the wide roads per text id; roads that share a text id each count their pings."""
    pings = inputs.only(inputs.pings_mercator(spark, sf_dir), "ping_id", "x", "y")
    roads = inputs.wide_roads_mercator(spark, sf_dir).select(F.col("text_id").alias("feature_id"), "kind", "parts")
    pairs = joins.near_lines(pings, roads, P.ROAD_RADIUS, plan=plan)
    return pairs.groupBy(F.col("feature_id").alias("text_id")).agg(F.count(F.lit(1)).alias("join_count"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment table of the roads: one row per segment with its end points,
    length and the bounding box of its `ROAD_RADIUS` buffer."""
    roads = inputs.roads_mercator(spark, sf_dir)
    segs = roads.select("feature_id", F.posexplode(geom.edges("parts")).alias("seg_idx", "s"))
    r = P.ROAD_RADIUS
    return segs.select(
        "feature_id",
        "seg_idx",
        *[F.round(F.col(f"s.{c}"), 3).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.round(geom.distance("s.x1", "s.y1", "s.x2", "s.y2"), 3).alias("length"),
        F.round(F.least("s.x1", "s.x2") - r, 3).alias("buf_min_x"),
        F.round(F.least("s.y1", "s.y2") - r, 3).alias("buf_min_y"),
        F.round(F.greatest("s.x1", "s.x2") + r, 3).alias("buf_max_x"),
        F.round(F.greatest("s.y1", "s.y2") + r, 3).alias("buf_max_y"),
    ).orderBy("feature_id", "seg_idx")


# ---------------------------------------------------------------------------
# time filters on pings
# ---------------------------------------------------------------------------
def pings_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings strictly between the two second-precision bounds, with their date."""
    window = second_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    p = filters.in_time_range(fixtures_pings(spark, sf_dir, window), P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)
    return p.select("ping_id", "sys_time", day_of("sys_time", P.OFFSET_MS).alias("day"))


def winter_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season filter (months 12, 1, 2) with the local time as text."""
    p = filters.in_months(fixtures_pings(spark, sf_dir), P.WINTER_MONTHS, P.OFFSET_MS)
    ts = local_timestamp("sys_time", P.OFFSET_MS)
    return p.select(
        "ping_id",
        "sys_time",
        timestamp_text("sys_time", P.OFFSET_MS).alias("time_text"),
        F.month(ts).alias("month"),
    )


def wide_winter_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season filter on pings of all months."""
    p = filters.in_months(fixtures.wide_pings(spark, sf_dir), P.WINTER_MONTHS, P.OFFSET_MS)
    return p.select("ping_id", "sys_time", F.month(local_timestamp("sys_time", P.OFFSET_MS)).alias("month"))


def wide_hourly_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly grid on pings that leave most hours empty and lie partly outside the box."""
    import math

    lo, hi = hour_slices(P.WIDE_GRID_FROM_TIME, P.WIDE_GRID_TO_TIME, P.OFFSET_MS)
    return aggregate.hourly_grid(fixtures.wide_pings(spark, sf_dir), P.GRID_BOX, int(math.isqrt(P.NUM_PARTITIONS)), lo, hi, P.OFFSET_MS)


def study_area_pings_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings (Mercator) strictly inside the study-area rectangle, per day."""
    p = filters.within_study_area(inputs.pings_mercator(spark, sf_dir))
    return p.groupBy(day_of("sys_time", P.OFFSET_MS).alias("day")).agg(F.count(F.lit(1)).alias("n_pings"))


def morning_pings_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings at local hour 8 in the date-cut range, per day."""
    p = filters.at_hour(
        filters.in_date_range(
            fixtures_pings(spark, sf_dir, date_bounds(P.FROM_TIME, P.TO_TIME, P.OFFSET_MS)),
            P.FROM_TIME,
            P.TO_TIME,
            P.OFFSET_MS,
        ),
        P.MORNING_HOUR,
        P.OFFSET_MS,
    )
    return p.groupBy(day_of("sys_time", P.OFFSET_MS).alias("day")).agg(F.count(F.lit(1)).alias("n_pings"))


def fixtures_pings(spark: SparkSession, sf_dir: str, window: tuple[int, int] | None = None) -> DataFrame:
    return fixtures.pings(spark, sf_dir, window)


# ---------------------------------------------------------------------------
# hourly grid and envelope
# ---------------------------------------------------------------------------
def hourly_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings per cell of a 4 x 4 equal grid over the fixed box, per hour of the
    whole fixture month; zero cells included for every hour with pings."""
    import math

    lo, hi = hour_slices(P.GRID_FROM_TIME, P.GRID_TO_TIME, P.OFFSET_MS)
    n = int(math.isqrt(P.NUM_PARTITIONS))
    return aggregate.hourly_grid(fixtures_pings(spark, sf_dir, (lo, hi)), P.GRID_BOX, n, lo, hi, P.OFFSET_MS)


def ping_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box of all pings in Mercator metres, and their count."""
    env = aggregate.envelope(inputs.pings_mercator(spark, sf_dir))
    return env.select(*[F.round(c, 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], "n")
