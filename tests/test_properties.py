"""Property tests: the cell joins equal a pure-Python brute force on random
inputs, for random cell sizes and both join strategies."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pingscape.functions import geom
from pingscape.operators import joins
from pingscape.operators.cells import JoinPlan

SETTINGS = dict(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
coord = st.floats(min_value=-1000.0, max_value=1000.0, allow_nan=False, allow_infinity=False)
points = st.lists(st.tuples(coord, coord), min_size=20, max_size=200)
PLANS = [JoinPlan(force="broadcast"), JoinPlan(force="shuffle", salts=3)]


def _seg_d(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    den = dx * dx + dy * dy
    t = 0.0 if den == 0 else max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / den))
    cx, cy = a[0] + t * dx, a[1] + t * dy
    return math.sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy))


def _inside(px, py, ring):
    c = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            c += 1
    return c % 2 == 1


@settings(**SETTINGS)
@given(pts=points, tgts=st.lists(st.tuples(coord, coord), min_size=1, max_size=30), radius=st.floats(5.0, 300.0),
       size_factor=st.sampled_from([0.3, 1.0, 4.0]), plan_i=st.integers(0, 1))
def test_within_distance_matches_bruteforce(spark, pts, tgts, radius, size_factor, plan_i):
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "ping_id long, x double, y double")
    t = spark.createDataFrame([(j, x, y) for j, (x, y) in enumerate(tgts)], "feature_id long, x double, y double")
    got = sorted(
        (r.ping_id, r.feature_id)
        for r in joins.within_distance(p, t, radius, cell_size=radius * size_factor, plan=PLANS[plan_i]).collect()
    )
    want = sorted(
        (i, j)
        for i, (x, y) in enumerate(pts)
        for j, (a, b) in enumerate(tgts)
        if math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) <= radius
    )
    assert got == want


@settings(**SETTINGS)
@given(pts=points, n_vertices=st.integers(3, 9), radius=st.floats(50.0, 600.0), scale=st.floats(0.2, 1.0),
       size=st.sampled_from([None, 40.0, 400.0]), plan_i=st.integers(0, 1))
def test_in_polygons_matches_bruteforce(spark, pts, n_vertices, radius, scale, size, plan_i):
    # a star-shaped (possibly concave) ring around the origin
    ring = []
    for k in range(n_vertices):
        ang = 2 * math.pi * k / n_vertices
        rr = radius * (scale if k % 2 else 1.0)
        ring.append((rr * math.cos(ang), rr * math.sin(ang)))
    ring.append(ring[0])
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + "))"
    polys = spark.createDataFrame([(1, wkt)], "feature_id long, t string").select(
        "feature_id", geom.wkt_kind("t").alias("kind"), geom.wkt_parts("t").alias("parts")
    )
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "ping_id long, x double, y double")
    got = sorted(r.ping_id for r in joins.in_polygons(p, polys, cell_size=size, plan=PLANS[plan_i]).collect())
    want = sorted(i for i, (x, y) in enumerate(pts) if _inside(x, y, ring))
    assert got == want


@settings(**SETTINGS)
@given(pts=points, line=st.lists(st.tuples(coord, coord), min_size=2, max_size=6), radius=st.floats(5.0, 200.0),
       plan_i=st.integers(0, 1))
def test_near_lines_matches_bruteforce(spark, pts, line, radius, plan_i):
    wkt = "LINESTRING (" + ", ".join(f"{x!r} {y!r}" for x, y in line) + ")"
    lines = spark.createDataFrame([(1, wkt)], "feature_id long, t string").select(
        "feature_id", geom.wkt_kind("t").alias("kind"), geom.wkt_parts("t").alias("parts")
    )
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "ping_id long, x double, y double")
    got = sorted(r.ping_id for r in joins.near_lines(p, lines, radius, plan=PLANS[plan_i]).collect())
    want = sorted(i for i, (x, y) in enumerate(pts) if min(_seg_d(x, y, a, b) for a, b in zip(line, line[1:])) < radius)
    assert got == want


H0 = 1704067200000
HOUR = 3600000


@settings(**SETTINGS)
@given(
    rows=st.lists(
        st.tuples(
            st.one_of(st.integers(0, 5 * HOUR), st.sampled_from([0, HOUR, 2 * HOUR, 5 * HOUR])),
            st.one_of(st.floats(-1.0, 5.0), st.sampled_from([0.0, 4.0])),
            st.one_of(st.floats(-1.0, 5.0), st.sampled_from([0.0, 4.0])),
        ),
        min_size=1,
        max_size=80,
    ),
    n=st.integers(1, 4),
)
def test_hourly_grid_matches_bruteforce(spark, rows, n):
    from pingscape.operators import aggregate

    box = (0.0, 0.0, 4.0, 4.0)
    lo, hi = H0, H0 + 4 * HOUR
    df = spark.createDataFrame(
        [(i, H0 + t, float(x), float(y)) for i, (t, x, y) in enumerate(rows)], "ping_id long, sys_time long, lng double, lat double"
    )
    got = {
        (int((r.hour_start - __import__("datetime").datetime(1970, 1, 1)).total_seconds() * 1000), r.cell_i, r.cell_j): r.number_of_records
        for r in aggregate.hourly_grid(df, box, n, lo, hi).collect()
    }
    want = {}
    hours = set()
    for t, x, y in rows:
        ms = H0 + t
        if not (lo < ms < hi) or ms % HOUR == 0:
            continue
        h = ms - ms % HOUR
        hours.add(h)
        if 0.0 <= x <= 4.0 and 0.0 <= y <= 4.0:
            i = min(n - 1, math.floor((x - 0.0) / 4.0 * n))
            j = min(n - 1, math.floor((y - 0.0) / 4.0 * n))
            want[(h, i, j)] = want.get((h, i, j), 0) + 1
    full = {(h, i, j): want.get((h, i, j), 0) for h in hours for i in range(n) for j in range(n)}
    assert got == full
