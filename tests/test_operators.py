"""Operators on hand-made rows (edges of every predicate) and properties on the
derived fixtures: cell size does not change a join, the salted shuffle path
equals the broadcast path, counts add up."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingscape.functions.timefn import MS_PER_DAY, MS_PER_HOUR
from pingscape.operators import aggregate, filters, joins
from pingscape.operators.cells import JoinPlan
from pingscape.plans import inputs

SF01 = "/root/testdata/sf0.01"

SHUFFLE_SALTED = JoinPlan(force="shuffle", salts=4)
SHUFFLE_AQE = JoinPlan(force="shuffle")
BROADCAST = JoinPlan(force="broadcast")


def _pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---------------------------------------------------------------------------
# distance join
# ---------------------------------------------------------------------------
def test_distance_boundary_closed_and_open(spark):
    pts = spark.createDataFrame(
        [(1, 3.0, 4.0), (2, 3.0, 4.0000001), (3, 0.0, 0.0), (4, 0.0, 0.0)], "ping_id long, x double, y double"
    )
    tgt = spark.createDataFrame([(10, 0.0, 0.0)], "feature_id long, x double, y double")
    closed = _pairs(joins.within_distance(pts, tgt, 5.0, closed=True), "ping_id", "feature_id")
    opened = _pairs(joins.within_distance(pts, tgt, 5.0, closed=False), "ping_id", "feature_id")
    assert closed == [(1, 10), (3, 10), (4, 10)]  # exactly r away is kept by <=
    assert opened == [(3, 10), (4, 10)]
    stats = aggregate.window_stats(joins.within_distance(pts, tgt, 5.0, closed=False)).first()
    assert (stats.n, stats.n_distinct) == (2, 1)  # equal coordinates: a bag of 2, a set of 1


def test_distance_join_independent_of_cell_size(spark):
    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y")
    pois = inputs.pois_mercator(spark, SF01)
    base = _pairs(joins.within_distance(pings, pois, 500.0), "ping_id", "feature_id")
    assert len(base) == 644  # anchor value, see FIXTURES.md
    for size in (137.0, 1000.0, 5000.0):
        assert _pairs(joins.within_distance(pings, pois, 500.0, cell_size=size), "ping_id", "feature_id") == base


@pytest.mark.parametrize("plan", [SHUFFLE_SALTED, SHUFFLE_AQE])
def test_shuffle_and_salted_path_equal_broadcast(spark, plan):
    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y")
    pois = inputs.pois_mercator(spark, SF01)
    a = _pairs(joins.within_distance(pings, pois, 500.0, plan=BROADCAST), "ping_id", "feature_id")
    b = _pairs(joins.within_distance(pings, pois, 500.0, plan=plan), "ping_id", "feature_id")
    assert a == b


def test_hot_cell_is_split(spark):
    # a third of all points in one cell: the salted join spreads it and stays exact
    hot = [(i, 10.0 + (i % 7) * 0.01, 10.0) for i in range(300)]
    cold = [(1000 + i, 500.0 + i * 3.0, 500.0) for i in range(600)]
    pts = spark.createDataFrame(hot + cold, "ping_id long, x double, y double")
    tgt = spark.createDataFrame([(1, 10.0, 10.0), (2, 800.0, 500.0)], "feature_id long, x double, y double")
    plan = JoinPlan(force="shuffle", salts=7)
    got = joins.within_distance(pts, tgt, 20.0, plan=plan)
    want = joins.within_distance(pts, tgt, 20.0, plan=BROADCAST)
    assert _pairs(got, "ping_id", "feature_id") == _pairs(want, "ping_id", "feature_id")
    assert got.where("feature_id = 1").count() == 300


# ---------------------------------------------------------------------------
# lines and polygons
# ---------------------------------------------------------------------------
def _shapes(spark, rows):
    from pingscape.functions import geom

    df = spark.createDataFrame(rows, "feature_id long, t string")
    return df.select("feature_id", geom.wkt_kind("t").alias("kind"), geom.wkt_parts("t").alias("parts"))


def test_near_lines_one_row_per_pair_and_strict(spark):
    lines = _shapes(spark, [(1, "LINESTRING (0 0, 10 0, 10 10)"), (2, "LINESTRING (100 100, 200 100)")])
    pts = spark.createDataFrame(
        [(1, 10.0, 0.5), (2, 5.0, 2.0), (3, 5.0, 1.0), (4, 150.0, 100.0), (5, 9.5, 0.5)], "ping_id long, x double, y double"
    )
    got = _pairs(joins.near_lines(pts, lines, 1.0), "ping_id", "feature_id")
    # ping 1 is near two segments of line 1 but appears once; ping 3 is exactly 1 away (outside)
    assert got == [(1, 1), (4, 2), (5, 1)]
    got_shuffle = _pairs(joins.near_lines(pts, lines, 1.0, plan=SHUFFLE_SALTED), "ping_id", "feature_id")
    assert got_shuffle == got


def test_in_polygons_edges_vertices_overlap(spark):
    polys = _shapes(
        spark,
        [
            (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"),
            (2, "POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))"),
        ],
    )
    pts = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 7.0, 7.0), (4, 10.0, 7.0), (5, 0.0, 0.0), (6, 12.0, 12.0), (7, 5.0, 0.0)],
        "ping_id long, x double, y double",
    )
    want = [(1, 1), (3, 1), (3, 2), (4, 2), (6, 2)]  # hole, edge and vertex excluded; overlap counted twice
    for size in (None, 1.0, 3.0, 50.0):
        assert _pairs(joins.in_polygons(pts, polys, cell_size=size), "ping_id", "feature_id") == want
    assert _pairs(joins.in_polygons(pts, polys, plan=SHUFFLE_SALTED), "ping_id", "feature_id") == want


# ---------------------------------------------------------------------------
# time filters, exposure window, hourly grid
# ---------------------------------------------------------------------------
def test_open_time_bounds(spark):
    lo, hi = 1704153600000, 1704240000000
    df = spark.createDataFrame([(1, lo), (2, lo + 1), (3, hi - 1), (4, hi)], "ping_id long, sys_time long")
    assert sorted(r.ping_id for r in filters.open_range(df, lo, hi).collect()) == [2, 3]
    off = filters.off_slice_edges(spark.createDataFrame([(1, lo), (2, lo + 5)], "ping_id long, sys_time long"), MS_PER_DAY)
    assert [r.ping_id for r in off.collect()] == [2]


def test_case_exposure_closed_window(spark):
    day0 = 19730  # 2024-01-08
    mid = day0 * MS_PER_DAY
    span = 10 * MS_PER_DAY
    pings = spark.createDataFrame(
        [(1, mid - span, 0.0, 0.0), (2, mid + span, 0.0, 0.0), (3, mid + span + 1, 0.0, 0.0), (4, mid - span - 1, 0.0, 0.0), (5, mid, 50.0, 0.0)],
        "ping_id long, sys_time long, x double, y double",
    )
    pairs = spark.createDataFrame(
        [(7, 0.0, 0.0, "2024-01-08"), (7, 0.0, 0.0, "2024-01-09")], "feature_id long, px double, py double, case_date string"
    ).withColumn("case_date", F.to_date("case_date"))
    hits = joins.case_exposure(pings, pairs, 10.0, days=10)
    got = sorted((r.ping_id, r.feature_id) for r in hits.collect() for _ in range(r.weight))
    # +-864000 s exactly is kept; the second case (one day later) matches 1..3 again except ping 1 (11 days before)
    assert got == [(1, 7), (2, 7), (2, 7), (3, 7)]


def test_hourly_grid_edges(spark):
    box = (0.0, 0.0, 4.0, 4.0)
    h0 = 1704067200000
    pings = spark.createDataFrame(
        [
            (1, h0 + 10, 0.5, 0.5),
            (2, h0 + 20, 4.0, 4.0),  # upper box edge -> last cell
            (3, h0 + 30, 9.0, 9.0),  # outside the box
            (4, h0 + MS_PER_HOUR, 1.0, 1.0),  # exactly on the hour -> dropped
            (5, h0 + 2 * MS_PER_HOUR + 5, 9.0, 9.0),  # an hour with pings, none in the box
        ],
        "ping_id long, sys_time long, lng double, lat double",
    )
    g = aggregate.hourly_grid(pings, box, 2, h0, h0 + 4 * MS_PER_HOUR)
    rows = g.collect()
    by_hour = {}
    for r in rows:
        by_hour.setdefault(str(r.hour_start), {})[(r.cell_i, r.cell_j)] = r.number_of_records
    assert set(by_hour) == {"2024-01-01 00:00:00", "2024-01-01 02:00:00"}  # empty hours give no rows
    assert by_hour["2024-01-01 00:00:00"] == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1}
    assert sum(by_hour["2024-01-01 02:00:00"].values()) == 0 and len(by_hour["2024-01-01 02:00:00"]) == 4


def test_day_counts_add_up(spark):
    from pingscape.plans import colocation

    by_day = colocation.poi_visits_by_day(spark, SF01)
    total = by_day.agg(F.sum("join_count")).first()[0]
    pings = filters.in_date_range(inputs.pings_mercator(spark, SF01), "2024-01-02 06:30:00", "2024-01-27 18:00:00")
    direct = joins.within_distance(inputs.only(pings, "ping_id", "x", "y"), inputs.pois_mercator(spark, SF01), 500.0).count()
    assert total == direct


def test_window_stats_distinct_le_bag(spark):
    from pingscape.plans import colocation

    for r in colocation.poi_window_stats(spark, SF01).collect():
        assert 0 < r.n_distinct <= r.n
        assert r.density == pytest.approx(r.n_distinct / (math.pi * 500.0 * 500.0))


def _lines(spark, rows):
    """Lines from `(id, parts)`, a part being a list of (x, y)."""
    schema = "feature_id long, parts array<array<struct<x:double,y:double>>>"
    return spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in p] for p in parts]) for k, parts in rows], schema)


def _grid_area(parts, r, cell):
    """Area within `r` of the line by the cells whose middle is: off by at most half a cell along the outline."""
    pts = np.array([q for p in parts for q in p], float)
    low = pts.min(0) - r
    wide = pts.max(0) + r - low
    gx, gy = np.meshgrid(np.arange(0, wide[0], cell) + cell / 2, np.arange(0, wide[1], cell) + cell / 2)
    inside = np.zeros(gx.shape, bool)
    for p in parts:
        for a, b in list(zip(p, p[1:])) or [(p[0], p[0])]:
            a, d = np.array(a, float) - low, np.array(b, float) - np.array(a, float)
            t = np.clip(((gx - a[0]) * d[0] + (gy - a[1]) * d[1]) / (d @ d), 0, 1) if d @ d else 0.0
            inside |= np.hypot(gx - a[0] - t * d[0], gy - a[1] - t * d[1]) < r
    return inside.sum() * cell * cell


def _sample_lines():
    rnd = random.Random(5)
    cases = [
        [[(1000, 1000), (3000, 1000)]],
        [[(0, 0), (0, 500), (0, 1000)]],
        [[(5, 5)]],
        [[(0, 0), (1000, 0), (200, 0), (500, 0)]],  # back over itself
        [[(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)]],  # a ring: a hole inside
        [[(0, 0), (600, 0), (600, 600), (600, 0), (0, 0)], [(300, -500), (300, 500)]],
        [[(0, 0), (1000, 0)], [(0, 200), (1000, 200)]],  # buffers that touch along a line
        [[(0, 0), (100, 0)], [(900, 900)]],  # two parts
        [[(0, 0), (0, 0), (50, 10), (90, 60), (60, 120), (0, 100)]],  # segments shorter than the radius, a vertex twice
    ]
    # Mercator-sized coordinates; crossings, and corners on a lattice with sides in common
    cases += [[[(1.3e7 + rnd.uniform(0, 900), 4.8e6 + rnd.uniform(0, 900)) for _ in range(rnd.randint(2, 9))]] for _ in range(20)]
    cases += [[[(100 * rnd.randint(0, 6), 100 * rnd.randint(0, 6)) for _ in range(rnd.randint(2, 9))] for _ in range(2)] for _ in range(10)]
    return list(enumerate(cases))


def test_line_buffer_area_against_a_fine_grid(spark):
    from pingscape.operators.buffers import line_buffer_area

    rows = _sample_lines()
    got = {r.feature_id: r for r in line_buffer_area(_lines(spark, rows), 100.0).collect()}
    assert got[0].area == pytest.approx(2 * 100 * 2000 + math.pi * 100**2, abs=1e-6)
    assert got[0].perimeter == pytest.approx(2 * 2000 + 2 * math.pi * 100, abs=1e-6)
    assert got[1].area == pytest.approx(2 * 100 * 1000 + math.pi * 100**2, abs=1e-6)
    assert got[2].area == pytest.approx(math.pi * 100**2, abs=1e-6)
    assert got[3].area == pytest.approx(2 * 100 * 1000 + math.pi * 100**2, abs=1e-6)
    assert got[4].area == pytest.approx(1200 * 1200 - (4 - math.pi) * 100**2 - 800 * 800, abs=1e-6)
    for k, parts in rows:
        # a cell is counted or not by its middle: the bound is half a cell on each metre of outline
        assert abs(got[k].area - _grid_area(parts, 100.0, 1.0)) <= 0.5 * got[k].perimeter + 1.0


def test_line_buffer_rows_are_lines_of_their_own(spark):
    from pingscape.operators.buffers import line_buffer_area, line_buffer_rings

    line = [[(0, 0), (300, 400)]]
    rows = _lines(spark, [(1, line), (1, line), (None, line), (None, [[(7, 7)]]), (3, []), (4, [[]])])
    got = sorted((r.feature_id or -1, round(r.area, 6)) for r in line_buffer_area(rows, 50.0).collect())
    capsule, disc = round(2 * 50 * 500 + math.pi * 2500, 6), round(math.pi * 2500, 6)
    assert got == [(-1, disc), (-1, capsule), (1, capsule), (1, capsule)]
    assert line_buffer_rings(rows, 50.0).count() == 4
    assert line_buffer_rings(rows.limit(0), 50.0).count() == 0
    bad = spark.createDataFrame([(1, [[(0.0, 0.0), (None, 1.0)]]), (2, None)], rows.schema)
    assert line_buffer_area(bad, 50.0).count() == 0


def test_line_buffer_rings(spark):
    from pingscape.functions import geom
    from pingscape.operators.buffers import line_buffer_rings
    from pingscape.operators.shapes import with_wkt

    rows = _sample_lines()
    fine = with_wkt(line_buffer_rings(_lines(spark, rows), 100.0, vertices=256))
    got = {r.feature_id: r for r in fine.withColumn("measured", geom.polygon_area("parts")).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert all(ring[0] == ring[-1] and len(ring) > 3 for ring in r.parts)
        # the rings cut the arcs short by at most this share of a full circle
        assert abs(r.area - r.measured) <= 0.0003 * r.perimeter * 100.0 + 1e-3
        assert r.wkt.startswith(r.kind + " ((")
    assert len(got[0].parts) == 1 and got[0].kind == "POLYGON"
    assert len(got[4].parts) == 2 and got[4].kind == "POLYGON"
    assert len(got[7].parts) == 2 and got[7].kind == "MULTIPOLYGON"
    signed = lambda ring: sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:]))
    assert signed(got[4].parts[0]) > 0 > signed(got[4].parts[1])
    # chunks of a long side leave no vertex on it: two half circles
    coarse = line_buffer_rings(_lines(spark, [(1, [[(0, 0), (5000, 0)]])]), 100.0).first()
    assert len(coarse.parts[0]) - 1 in (34, 36)


def test_line_buffer_pieces_join_by_cells(spark):
    from pingscape.operators.buffers import line_buffer_pieces

    plan = line_buffer_pieces(_lines(spark, _sample_lines()), 100.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "SortMergeJoin" in plan


def test_circle_ring(spark):
    from pingscape.functions import geom
    from pingscape.operators.buffers import circle_ring

    df = spark.createDataFrame([(10.0, 20.0)], "x double, y double").select(circle_ring("x", "y", 5.0, 64).alias("p"))
    r = df.select("p", geom.polygon_area("p").alias("a")).first()
    ring = r.p[0]
    assert len(ring) == 65 and ring[0] == ring[-1]
    assert r.a == pytest.approx(math.pi * 25, rel=0.01)


def test_in_polygons_small_cells_use_interior_cells(spark):
    from pingscape.operators.joins import polygon_cells

    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y")
    zones = inputs.zones_mercator(spark, SF01)
    base = _pairs(joins.in_polygons(pings, zones), "ping_id", "feature_id")
    assert len(base) == 2586
    assert _pairs(joins.in_polygons(pings, zones, cell_size=90.0), "ping_id", "feature_id") == base
    cells = polygon_cells(zones, 90.0)
    full = cells.where("full").count()
    assert full > cells.where("not full").count()  # most cells need no per-ping test
    assert cells.where("full").where("size(edges) > 0").count() == 0


def test_composed_exposure_equals_plan(spark):
    from pingscape.operators.filters import STUDY_AREA
    from pingscape.plans import colocation
    from pingscape.plans import params as P

    pings = filters.in_date_range(
        inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "sys_time", "x", "y"), P.FROM_TIME, P.TO_TIME
    )
    got = joins.exposure_by_day(
        pings, inputs.pois_mercator(spark, SF01), inputs.cases_mercator(spark, SF01), 800.0, 2000.0, study_area=STUDY_AREA
    )
    want = colocation.case_exposure_by_day(spark, SF01)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_shape_helpers(spark):
    from pingscape.operators import shapes

    df = spark.createDataFrame([(1, "LINESTRING (0 0, 1 1, 2 0)"), (2, "bad")], "feature_id long, geometry string")
    dec = shapes.decode_wkt(df)
    assert [r.feature_id for r in dec.collect()] == [1]
    segs = shapes.segments(dec).collect()
    assert [(r.seg_idx, r.x1, r.y2) for r in segs] == [(0, 0.0, 1.0), (1, 1.0, 0.0)]
    env = shapes.shape_envelopes(dec).first()
    assert (env.min_x, env.max_x, env.max_y) == (0.0, 2.0, 1.0)
    assert shapes.with_wkt(dec, decimals=2).first().wkt == "LINESTRING (0.00 0.00, 1.00 1.00, 2.00 0.00)"
    circles = shapes.circle_rings(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), 1.0, 8).first()
    assert circles.kind == "POLYGON" and len(circles.parts[0]) == 9


def test_broadcast_check_counts_array_elements(spark):
    from pingscape.operators.cells import fits

    df = spark.createDataFrame([(i, list(range(100))) for i in range(10)], "k int, a array<int>")
    assert fits(df, 10)
    assert not fits(df, 9)
    assert fits(df, 10, 40_000)
    assert not fits(df, 10, 10 * 100 * 4)
    wide = spark.createDataFrame([(1, "x" * 5000, {"k": "y" * 3000})], "k int, t string, m map<string,string>")
    assert fits(wide, 1, 9000) and not fits(wide, 1, 8000)
    # polygons with many edges per cell fall back to the shuffle path and stay exact
    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y")
    zones = inputs.zones_mercator(spark, SF01)
    tight = JoinPlan(max_broadcast_bytes=10)
    assert _pairs(joins.in_polygons(pings, zones, plan=tight), "ping_id", "feature_id") == _pairs(
        joins.in_polygons(pings, zones), "ping_id", "feature_id"
    )


def test_in_polygons_mixed_sizes_use_levels(spark):
    from pingscape.operators.joins import polygon_cells, polygon_levels

    polys = _shapes(
        spark,
        [
            (1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"),
            (2, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))"),
            (3, "POLYGON ((-500 -500, 900 -500, 900 700, -500 700, -500 -500), (10 10, 20 10, 20 20, 10 20, 10 10))"),
        ],
    )
    pts = spark.createDataFrame(
        [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 15.0, 15.0), (4, 800.0, 600.0), (5, 950.0, 0.0), (6, 4.0, 2.0)],
        "ping_id long, x double, y double",
    )
    want = [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (4, 3), (6, 3)]
    assert _pairs(joins.in_polygons(pts, polys, cell_size=1.0), "ping_id", "feature_id") == want
    assert _pairs(joins.in_polygons(pts, polys, cell_size=1.0, plan=SHUFFLE_SALTED), "ping_id", "feature_id") == want
    levels = {r.feature_id: r.level for r in polygon_levels(polys, 1.0).collect()}
    assert levels[1] == 0 and levels[2] == 0 and levels[3] > 0
    per_poly = {r.feature_id: r["count"] for r in polygon_cells(polys, 1.0).groupBy("feature_id").count().collect()}
    assert per_poly[3] <= 65 * 65  # bounded by the level, not by the polygon's size


def test_near_lines_long_diagonals_band_cells(spark):
    import random

    from pingscape.operators.joins import segment_cells

    rnd = random.Random(7)
    lines = _shapes(
        spark,
        [
            (1, "LINESTRING (0 0, 5000 3700, 5200 -800)"),
            (2, "LINESTRING (100 4000, 4100 4010)"),
            (3, "LINESTRING (2500 -1000, 2500.5 5000)"),
        ],
    )
    pts = [(i, rnd.uniform(-300, 5500), rnd.uniform(-1200, 5200)) for i in range(3000)]
    df = spark.createDataFrame(pts, "ping_id long, x double, y double")
    got = _pairs(joins.near_lines(df, lines, 60.0), "ping_id", "feature_id")

    def seg_d(px, py, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - (a[0] + t * dx), py - (a[1] + t * dy))

    shapes = {
        1: [(0, 0), (5000, 3700), (5200, -800)],
        2: [(100, 4000), (4100, 4010)],
        3: [(2500, -1000), (2500.5, 5000)],
    }
    want = sorted(
        (i, f) for i, x, y in pts for f, v in shapes.items() if min(seg_d(x, y, a, b) for a, b in zip(v, v[1:])) < 60.0
    )
    assert got == want and len(want) > 50
    # cells follow the band, not the bounding box of the diagonal segments
    n_cells = segment_cells(lines, 60.0, 60.0).where("feature_id = 1").count()
    assert n_cells < 0.25 * (5300 / 60.0) * (4600 / 60.0)


@pytest.mark.parametrize("plan", [SHUFFLE_SALTED, SHUFFLE_AQE])
def test_exposure_shuffle_paths_equal_broadcast(spark, plan):
    from pingscape.operators.filters import STUDY_AREA

    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "sys_time", "x", "y")
    args = (pings, inputs.pois_mercator(spark, SF01), inputs.cases_mercator(spark, SF01), 800.0, 2000.0)
    a = joins.exposure_by_day(*args, study_area=STUDY_AREA, plan=BROADCAST)
    b = joins.exposure_by_day(*args, study_area=STUDY_AREA, plan=plan)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_heat_blur_and_cap_on_hand_made_points(spark):
    from pingscape.functions.tiles import EQUATOR
    from pingscape.operators import raster

    # pixel centres at zoom 10: one point alone, and 40 points stacked on one pixel
    z = 10
    size = EQUATOR / (256 * 2**z)

    def centre(px, py):
        return (px + 0.5) * size - EQUATOR / 2, EQUATOR / 2 - (py + 0.5) * size

    lone = centre(100000, 90000)
    hot = centre(100010, 90000)
    pts = spark.createDataFrame([lone] + [hot] * 40, "x double, y double")
    spans = raster.tile_spans(raster.box_envelope(spark, (-EQUATOR / 2, -EQUATOR / 2, EQUATOR / 2, EQUATOR / 2)), z, z)
    pix = {(r.px, r.py): r for r in raster.heat_pixels(pts, z, z, blur=1, cap=2.0, spans=spans).collect()}
    assert len(pix) == 18
    r = pix[(100000, 90000)]
    assert (r.n_sum, r.value, r.intensity) == (1, 1 / 9, (1 / 9) / 2.0)
    h = pix[(100011, 90001)]
    assert h.n_sum == 40 and h.intensity == 1.0  # capped at 2.0, scaled to 1


def test_line_pixels_contiguous(spark):
    from pingscape.functions.tiles import EQUATOR
    from pingscape.operators import raster

    z = 12
    size = EQUATOR / (256 * 2**z)
    y = EQUATOR / 2 - (500000 + 0.5) * size
    x0 = (700000 + 0.5) * size - EQUATOR / 2
    x1 = (700020 + 0.5) * size - EQUATOR / 2
    lines = _shapes(spark, [(1, f"LINESTRING ({x0!r} {y!r}, {x1!r} {y!r})")])
    spans = raster.tile_spans(raster.box_envelope(spark, (-EQUATOR / 2, -EQUATOR / 2, EQUATOR / 2, EQUATOR / 2)), z, z)
    got = sorted((r.px, r.py) for r in raster.line_pixels(lines, spans, z, z).collect())
    assert got == [(700000 + i, 500000) for i in range(21)]


def test_size_check_ships_one_row_per_task(spark):
    import contextlib
    import io

    from pingscape.operators import cells

    seen = []
    real = cells.row_width

    def spy(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.agg(F.count(F.lit(1)), F.sum(real(df).cast("long"))).explain()
        seen.append(buf.getvalue())
        return real(df)

    cells.row_width = spy
    try:
        joins.within_distance(inputs.pings_mercator(spark, SF01), inputs.pois_mercator(spark, SF01), 500.0)
    finally:
        cells.row_width = real
    assert seen and "Limit" not in seen[0]
    # partial aggregate below the only exchange
    assert seen[0].index("Exchange SinglePartition") < seen[0].index("partial_count")


def test_shuffle_path_reads_the_points_once(spark):
    for plan in (SHUFFLE_AQE, SHUFFLE_SALTED):
        j = joins.within_distance(inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y"), inputs.pois_mercator(spark, SF01), 500.0, plan=plan)
        text = j._jdf.queryExecution().executedPlan().toString()
        assert text.count("event_id") and text.count("FileScan parquet [event_id") == 1
        assert "SortMergeJoin" in text


def test_identical_positions_are_spread(spark):
    pts = spark.createDataFrame([(i, 0.0, 0.0) for i in range(2000)], "ping_id long, x double, y double")
    salt = F.pmod(F.xxhash64("ping_id", "x", "y"), F.lit(16))
    assert pts.select(salt).distinct().count() == 16
    tgt = spark.createDataFrame([(1, 0.0, 0.0)], "feature_id long, x double, y double")
    assert joins.within_distance(pts, tgt, 1.0, plan=JoinPlan(force="shuffle", salts=16)).count() == 2000
    on = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        j = joins.within_distance(pts, tgt, 1.0, plan=SHUFFLE_AQE)
        assert "_salt" in j._jdf.queryExecution().toString() and j.count() == 2000
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", on)


def test_lines_that_share_an_id_stay_apart(spark):
    lines = spark.createDataFrame(
        [("A", "LINESTRING", [[(0.0, 0.0), (10.0, 0.0)]]), ("A", "LINESTRING", [[(0.0, 0.5), (10.0, 0.5)]]), (None, "LINESTRING", [[(100.0, 0.0), (110.0, 0.0)]]), (None, "LINESTRING", [[(200.0, 0.0)]])],
        "feature_id string, kind string, parts array<array<struct<x:double,y:double>>>",
    )
    pts = spark.createDataFrame([(1, 5.0, 0.2), (2, 105.0, 0.2), (3, 200.0, 0.3)], "ping_id long, x double, y double")
    got = sorted(_pairs(joins.near_lines(pts, lines, 1.0), "ping_id", "feature_id"), key=str)
    assert got == [(1, "A"), (1, "A"), (2, None), (3, None)]


def test_hourly_grid_grows_with_its_cells(spark):
    import time

    pings = spark.createDataFrame([(1 + i * 97, 0.1 + (i % 10) * 0.05, 0.2 + (i % 7) * 0.1) for i in range(200)], "sys_time long, lng double, lat double")
    took = {}
    for n in (4, 100, 300):
        start = time.time()
        out = aggregate.hourly_grid(pings, (0.0, 0.0, 1.0, 1.0), n, 0, MS_PER_HOUR)
        assert out.agg(F.count(F.lit(1)), F.sum("number_of_records")).first() == (n * n, 200)
        took[n] = time.time() - start
    assert took[300] < took[4] + 10


def test_polygon_with_many_vertices_is_split_over_rows(spark):
    from pingscape.operators.joins import polygon_cells

    n = 20_000
    ring = [(1000 * math.cos(2 * math.pi * k / n), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    polys = spark.createDataFrame([(1, "POLYGON", [ring + ring[:1]])], "feature_id long, kind string, parts array<array<struct<x:double,y:double>>>")
    cells = polygon_cells(polys, 100.0).collect()
    # a cell's edges are those of its row, not the whole ring
    assert max(len(c.edges) for c in cells) < n / 4 and sum(c.full for c in cells) > 200
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 999.0, 0.0), (3, 1001.0, 0.0), (4, 710.0, 710.0), (5, 700.0, 700.0)], "ping_id long, x double, y double")
    assert _pairs(joins.in_polygons(pts, polys, cell_size=100.0), "ping_id") == [(1,), (2,), (5,)]


def test_spans_grow_with_the_outline(spark):
    from pingscape.operators.joins import polygon_cells, polygon_spans, span_runs

    polys = _shapes(spark, [(1, "POLYGON ((0.5 0.5, 60.5 0.5, 60.5 60.5, 0.5 60.5, 0.5 0.5), (20.5 20.5, 40.5 20.5, 40.5 40.5, 20.5 40.5, 20.5 20.5))")])
    spans, cells = polygon_spans(polys, 1.0), polygon_cells(polys, 1.0)
    outline = 4 * 60 + 4 * 20
    assert cells.where("full").count() > 3 * outline
    assert spans.where("full").count() <= 2 * 60 and spans.where("not full").count() <= 1.1 * outline
    assert span_runs(spans).count() < cells.count() / 2
    # runs are the spans' cells, each once
    once = span_runs(spans).select("cy", "full", F.explode(F.sequence(F.expr("shiftleft(cx, run)"), F.expr("shiftleft(cx + 1, run) - 1"))).alias("cx"))
    assert sorted(map(tuple, once.select("cx", "cy", "full").collect())) == sorted(map(tuple, cells.select("cx", "cy", "full").collect()))


def test_runs_of_any_span(spark):
    import random

    from pingscape.operators.joins import span_runs

    rng = random.Random(3)
    rows = [(i, 0, lo, lo + rng.randrange(70), 0, True, []) for i, lo in enumerate(rng.randrange(-100, 100) for _ in range(300))]
    spans = spark.createDataFrame(rows, "feature_id long, level int, cx_lo long, cx_hi long, cy long, full boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = {}
    for r in span_runs(spans).collect():
        got.setdefault(r.feature_id, []).extend(range(r.cx << r.run, (r.cx + 1) << r.run))
    assert {i: sorted(v) for i, v in got.items()} == {r[0]: list(range(r[2], r[3] + 1)) for r in rows}


def test_rows_of_shapes_keep_their_number(spark):
    from pingscape.operators.cells import apart

    rows = [(1, [1.0]), (1, [1.0]), (None, [2.0]), (2, None), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "feature_id long, v array<double>")
    one, two = ({(r.feature_id, str(r.v), r["shape"]) for r in apart(x).collect()} for x in (df, df.repartition(5)))
    assert one == two and len(one) == len(rows)


def test_windows_of_positions_equal_windows_of_points(spark):
    import random

    rng = random.Random(8)
    pts = spark.createDataFrame([(i, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(600)], "ping_id long, x double, y double")
    polys = _shapes(spark, [(1, "POLYGON ((0.5 0.5, 6.5 0.5, 6.5 6.5, 0.5 0.5))"), (2, "POLYGON ((3 3, 9 3, 9 9, 3 9, 3 3))"), (2, "POLYGON ((5 5, 11 5, 11 11, 5 11, 5 5))"), (None, "POLYGON ((1 1, 4 1, 4 4, 1 4, 1 1))")])
    for shapes in (polys, polys.where("feature_id = 1")):
        join = lambda p, t: joins.in_polygons(p, t, cell_size=1.0)
        want = aggregate.window_stats(join(pts, shapes), "feature_id")
        assert sorted(map(tuple, aggregate.stats_per_window(pts, shapes, join).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_line_windows_keep_every_row(spark):
    from pingscape.plans.colocation import line_window_stats

    lines = _shapes(spark, [(7, "LINESTRING (0 0, 1000 0)"), (7, "LINESTRING (0 0, 1000 0)"), (None, "LINESTRING (0 5000, 1000 5000)"), (9, "LINESTRING (0 90000, 1 90000)")])
    lines = lines.unionByName(spark.createDataFrame([(5, "LINESTRING", [[(500.0, 20.0)]])], lines.schema))
    pts = spark.createDataFrame([(1, 500.0, 10.0), (2, 500.0, 10.0), (3, 10.0, 5050.0)], "ping_id long, x double, y double")
    got = sorted((r.feature_id or 0, r.n, r.n_distinct, r.area) for r in line_window_stats(pts, lines, 100.0).collect())
    capsule, circle = 2 * 100 * 1000 + math.pi * 100**2, math.pi * 100**2
    assert [g[:3] for g in got] == [(0, 1, 1), (5, 2, 1), (7, 2, 1), (7, 2, 1)]
    assert [g[3] for g in got] == pytest.approx([capsule, circle, capsule, capsule], rel=0.01)


def _pixels_stepwise(parts, span, z):
    """Pixels of a line by plain stepping along the longer axis, kept where inside the span."""
    from pingscape.functions.tiles import EQUATOR

    scale, half, hits = 2.0**z * 256.0, EQUATOR / 2.0, {}
    for p in parts:
        for (x1, y1), (x2, y2) in zip(p, p[1:]):
            fx1, fy1 = (x1 + half) / EQUATOR * scale, (half - y1) / EQUATOR * scale
            fx2, fy2 = (x2 + half) / EQUATOR * scale, (half - y2) / EQUATOR * scale
            steps = max(abs(math.floor(fx2) - math.floor(fx1)), abs(math.floor(fy2) - math.floor(fy1)))
            for t in range(steps + 1):
                px = math.floor(fx1 + (fx2 - fx1) * t / max(steps, 1))
                py = math.floor(fy1 + (fy2 - fy1) * t / max(steps, 1))
                if span[0] * 256 <= px < (span[2] + 1) * 256 and span[1] * 256 <= py < (span[3] + 1) * 256:
                    hits[z, px, py] = hits.get((z, px, py), 0) + 1
    return hits


def test_clipped_line_pixels_equal_plain_stepping(spark):
    from pingscape.operators import raster

    rnd = random.Random(9)
    x0, y0 = 12957000.0, 4852000.0
    lines = [[[(x0 + rnd.uniform(-2e5, 2e5), y0 + rnd.uniform(-2e5, 2e5)) for _ in range(4)]] for _ in range(12)]
    lines += [[[(x0, y0 - 3e5), (x0, y0 + 3e5)]], [[(x0 - 3e5, y0), (x0 + 3e5, y0)]], [[(x0, y0), (x0, y0)]], [[(x0 + 9e5, y0), (x0 + 9e5, y0 + 10)]]]
    box = (x0 - 5000.0, y0 - 5000.0, x0 + 5000.0, y0 + 5000.0)
    spans = raster.tile_spans(raster.box_envelope(spark, box), 10, 13)
    rows = _lines(spark, list(enumerate(lines)) + [(99, [[(math.nan, 0.0), (x0, y0)]]), (100, [[(math.inf, 0.0), (x0, y0)]])])
    got = {(r.z, r.px, r.py): r.hits for r in raster.line_pixels(rows, spans, 10, 13).collect()}
    want = {}
    for s in spans.collect():
        for parts in lines:
            for k, n in _pixels_stepwise(parts, (s.tx0, s.ty0, s.tx1, s.ty1), s.z).items():
                want[k] = want.get(k, 0) + n
    assert got == want and len(got) > 100


def test_long_lines_are_stepped_in_short_ranges(spark):
    from pingscape.operators import raster

    # 1,000 km at zoom 18: 1.7 million pixels
    x0, y0 = 12957000.0, 4852000.0
    row = _lines(spark, [(1, [[(x0, y0), (x0 + 1e6, y0 + 4e5)]])])
    everywhere = raster.tile_spans(raster.box_envelope(spark, (x0 - 1.0, y0 - 1.0, x0 + 1e6, y0 + 4e5)), 18, 18)
    near = raster.tile_spans(raster.box_envelope(spark, (x0 - 1000.0, y0 - 1000.0, x0 + 1000.0, y0 + 1000.0)), 18, 18)
    segs = spark.sql("SELECT 18 AS z, 1.0D AS fx1, 1.0D AS fy1, 1674001.5D AS fx2, 700000.5D AS fy2, 1674000L AS steps, 0 AS tx0, 0 AS ty0, 262143 AS tx1, 262143 AS ty1")
    ranges = raster._step_ranges(segs, 18).selectExpr("t0", "t1").orderBy("t0").collect()
    assert max(r.t1 - r.t0 for r in ranges) < raster.STEP_RANGE
    assert ranges[0].t0 == 0 and ranges[-1].t1 == 1674000
    assert all(a.t1 + 1 == b.t0 for a, b in zip(ranges, ranges[1:]))
    whole = raster.line_pixels(row, everywhere, 18, 18).agg(F.sum("hits")).first()[0]
    part = raster.line_pixels(row, near, 18, 18).agg(F.sum("hits")).first()[0]
    assert whole > 1_600_000 and 0 < part < 5000


def test_wide_line_tiles_are_clipped(spark):
    from pingscape.plans import tilemaps

    inside = {(r.z, r.tx, r.ty) for r in tilemaps.wide_line_tiles_beijing(spark, SF01).collect()}
    every = {(r.z, r.tx, r.ty) for r in tilemaps.wide_line_tiles(spark, SF01).collect()}
    assert inside and inside < every


def _square(x, y, half, back=False):
    ring = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)]
    return ring[::-1] if back else ring


def test_ring_nesting_by_hand(spark):
    from pingscape.operators.nesting import polygon_measures, ring_nesting

    touching = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0), (0.0, 0.0)]  # shares three sides with the square below
    # a horseshoe around a square that it does not hold, though its box does
    shoe = [(0, 0), (20, 0), (20, 20), (15, 20), (15, 5), (5, 5), (5, 20), (0, 20), (0, 0)]
    rows = _lines(spark, [
        (1, [_square(0, 0, 1), _square(0, 0, 3, True), _square(0, 0, 2), _square(10, 0, 1), _square(0, 0, 3)]),
        (2, [_square(5, 5, 5), touching]),
        (3, [shoe, _square(10, 10, 2), _square(2, 10, 1)]),
        (3, [shoe, [(3, 3), (4, 4), (3, 3)], [(1, math.nan), (2, 2), (3, 1), (1, 1)]]),
        (None, [_square(0, 0, 1)]),
        (4, []),
    ])
    got = {}
    for r in ring_nesting(rows).collect():
        got.setdefault((r.feature_id, r.shape), {})[r.ring] = (r.depth, r.parent)
    by_id = {}
    for (k, _), rings in sorted(got.items(), key=str):
        by_id.setdefault(k, []).append([rings[i] for i in sorted(rings)])
    assert by_id[1] == [[(3, 2), (1, 4), (2, 1), (0, None), (0, None)]]
    assert by_id[2] == [[(0, None), (1, 0)]]
    assert sorted(by_id[3]) == sorted([[(0, None), (0, None), (1, 0)], [(0, None), (0, None), (0, None)]])
    assert by_id[None] == [[(0, None)]] and 4 not in by_id
    shapes = rows.withColumn("kind", F.lit("MULTIPOLYGON"))
    measures = {(r.feature_id, r.n_rings): (r.n_members, r.area) for r in polygon_measures(shapes).collect()}
    assert measures[(1, 5)] == (3, 36.0 - 36.0 + 16.0 - 4.0 + 4.0)
    assert measures[(4, 0)] == (0, 0.0) and measures[(None, 1)] == (1, 4.0)
    assert ring_nesting(rows.limit(0)).count() == 0


def test_ring_nesting_of_one_shape_with_many_rings(spark):
    from pingscape.operators.nesting import polygon_measures, ring_nesting

    # a field of blocks, each with a yard, each yard with a hut; and one wall around them all
    side, rnd = 60, random.Random(2)
    rings, want = [], {}
    for i in range(side):
        for j in range(side):
            for depth, half in ((1, 4.0), (2, 2.0), (3, 1.0)):
                ring = _square(1.2e7 + 10 * i, 4.8e6 + 10 * j, half, rnd.random() < 0.5)
                rings.append((ring, depth, half * half * 4))
    rings.append((_square(1.2e7 + 5 * side, 4.8e6 + 5 * side, 10.0 * side), 0, (20.0 * side) ** 2))
    rnd.shuffle(rings)
    row = _lines(spark, [(1, [r for r, _, _ in rings])])
    nested = ring_nesting(row)
    for r in nested.select("ring", "depth", "area").collect():
        assert (r.depth, round(r.area, 3)) == rings[r.ring][1:]
    m = polygon_measures(row.withColumn("kind", F.lit("MULTIPOLYGON"))).first()
    assert m.n_rings == len(rings) == 3 * side * side + 1 and m.n_members == side * side + 1
    assert m.area == pytest.approx(sum(a if d % 2 == 0 else -a for _, d, a in rings))
    plan = nested._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sql_join_by_shape_cells(spark):
    from pingscape.functions.sql import register_sql_functions
    from pingscape.plans import colocation

    register_sql_functions(spark)
    rnd = random.Random(4)
    at = lambda: (rnd.uniform(-900, 900), rnd.uniform(-900, 900))
    lines = _lines(spark, [(k, [[at() for _ in range(rnd.randint(1, 4))] for _ in range(2)]) for k in range(12)] + [(50, [[(0, -700), (0, 700)]]), (51, [])])
    points = spark.createDataFrame([(i, *at()) for i in range(400)], "ping_id long, x double, y double")
    for cell in (35.0, 100.0, 700.0):
        cells = spark.sql(f"SELECT feature_id, parts, cx, cy FROM (SELECT *, shape_cells(parts, 100D, {cell}D) AS cells FROM {{lines}}) LATERAL VIEW inline(cells) c AS cx, cy", lines=lines)
        assert cells.count() == cells.select("feature_id", "cx", "cy").distinct().count()
        got = spark.sql(
            f"SELECT ping_id, feature_id FROM {{points}} JOIN {{cells}} ON cell_of(x, {cell}D) = cx AND cell_of(y, {cell}D) = cy "
            "WHERE shape_near(x, y, 100D, parts)", points=points, cells=cells)
        want = spark.sql("SELECT ping_id, feature_id FROM {points} CROSS JOIN {lines} WHERE shape_near(x, y, 100D, parts)", points=points, lines=lines)
        assert _pairs(got, "ping_id", "feature_id") == _pairs(want, "ping_id", "feature_id") and got.count() > 100
    plan = colocation.road_visits_sql(spark, SF01)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan and "Python" not in plan


def test_sql_visits_by_refined_cells(spark):
    from pingscape.functions.sql import register_sql_functions
    from pingscape.plans import colocation

    register_sql_functions(spark)
    rnd = random.Random(9)
    at = lambda: (rnd.uniform(-900, 900), rnd.uniform(-900, 900))
    shapes = [(k % 9, [[at() for _ in range(rnd.randint(1, 4))] for _ in range(2)]) for k in range(12)]
    lines = _lines(spark, [*shapes, (50, [[(0, -700), (0, 700)]]), (50, [[(0, -700), (0, 700)]]), (51, [])])
    # a crowd, points at the radius itself and points that come twice
    crowd = [(rnd.gauss(0, 40), rnd.gauss(0, 40)) for _ in range(500)]
    points = [(*p, k % 3) for k, p in enumerate([at() for _ in range(500)] + crowd + [(100.0, 0.0), (-100.0, 5.0), (0.0, 800.0)] + crowd[:50])]
    points = spark.createDataFrame([(x, y, d) for x, y, d in points], "x double, y double, day int")
    want = _pairs(spark.sql("SELECT feature_id, day, count(*) AS n FROM {points} CROSS JOIN {lines} WHERE shape_near(x, y, 100D, parts) GROUP BY 1, 2", points=points, lines=lines), "feature_id", "day", "n")
    for halvings in (0, 3):
        assert _pairs(colocation.line_visits_sql(points, lines, 100.0, halvings), "feature_id", "day", "join_count") == want
    # cells wholly inside the buffer take counts: pairs are not counted one by one
    plan = colocation.line_visits_sql(points, lines, 100.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "inside" in plan and "sum(n" in plan and "count(1) AS n" in plan


def test_heat_blur_is_dealt_by_tile(spark, monkeypatch):
    from collections import Counter

    from pingscape.operators import raster

    rnd = random.Random(2)
    size = 40075016.68557849 / (256 * 2**9)
    # pixels around a corner of four tiles, some often, and one on a far tile
    pixels = [(256 * 400 + rnd.randint(-4, 3), 256 * 190 + rnd.randint(-4, 3)) for _ in range(60)] + [(256 * 300 + 255, 256 * 100)] * 5
    points = spark.createDataFrame([((px + 0.5) * size - 40075016.68557849 / 2, 40075016.68557849 / 2 - (py + 0.5) * size) for px, py in pixels], "x double, y double")
    for blur in (1, 3):
        want = Counter()
        for (px, py), n in Counter(pixels).items():
            for dx in range(-blur, blur + 1):
                for dy in range(-blur, blur + 1):
                    want[px + dx, py + dy] += n
        want = {k: n for k, n in want.items() if 300 * 256 <= k[0] < 401 * 256 and 100 * 256 <= k[1] < 191 * 256}
        for each in (1 << 17, 7):
            monkeypatch.setattr(raster, "BLUR_PIXELS", each)
            got = raster.heat_pixels(points, 9, 9, blur)
            assert {(r.px, r.py): r.n_sum for r in got.collect()} == want
    # more tasks for more pixels, and no exchange of the blurred pixels between the passes
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert raster._blur_tasks(points, 1, 9) > 1 and "hashpartitioning(z" in plan and "REPARTITION_BY_NUM" in plan


def test_counts_in_polygons_equal_their_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    polys = []
    for k in range(14):
        x, y, h = rnd.randint(0, 60), rnd.randint(0, 60), rnd.choice([2, 5, 40])
        ring = [(x, y), (x + h, y), (x + h, y + h), (x + h // 2, y + h + 3), (x, y + h), (x, y)]
        hole = [(x + h / 4, y + h / 4), (x + h / 2, y + h / 4), (x + h / 4, y + h / 2), (x + h / 4, y + h / 4)]
        polys.append((k, [ring, hole]))
    # on corners and edges too, and a crowd of positions in one cell
    rows = [(float(rnd.randint(-2, 105)), float(rnd.randint(-2, 105)), rnd.randint(1, 3)) for _ in range(600)]
    rows += [(30 + rnd.random(), 30 + rnd.random(), 1) for _ in range(400)] + [(rnd.uniform(0, 100), rnd.uniform(0, 100), 2) for _ in range(300)]
    shapes, positions = _lines(spark, polys), spark.createDataFrame(list({r[:2]: r for r in rows}.values()), "x double, y double, weight long")
    pairs = joins.in_polygons(positions, shapes)
    want = _pairs(pairs.groupBy("feature_id").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("m")), "feature_id", "n", "m")
    assert len(want) > 8
    for size, at_once, plan in ((None, 4096, JoinPlan()), (7.0, 3, SHUFFLE_AQE)):
        monkeypatch.setattr(joins, "EDGES_AT_ONCE", at_once)
        got = joins.count_in_polygons(positions, shapes, size, plan, max_cells_per_axis=4)
        assert _pairs(got, "feature_id", "n", "n_distinct") == want
    # the registered query counts this way: no row for a pair
    from pingscape.plans import colocation

    assert "_count_rows" in colocation.block_totals(spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
