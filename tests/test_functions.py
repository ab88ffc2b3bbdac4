"""Scalar column functions against fixed values and independent Python formulas."""

import math

import pytest
from pyspark.sql import functions as F

from pingscape.functions import crs, geom, tiles, timefn


def _one(spark, cols, data, schema):
    return spark.createDataFrame(data, schema).select(*cols).first()


def test_mercator_known_values(spark):
    r = _one(spark, [crs.mercator_x("lng").alias("x"), crs.mercator_y("lat").alias("y")], [(116.4, 39.9)], "lng double, lat double")
    assert r.x == pytest.approx(math.radians(116.4) * 6378137.0, rel=1e-15)
    assert r.y == pytest.approx(math.log(math.tan(math.pi / 4 + math.radians(39.9) / 2)) * 6378137.0, rel=1e-12)


def test_mercator_inverse_round_trip(spark):
    df = spark.createDataFrame([(116.4, 39.9), (-70.1, -33.4)], "lng double, lat double")
    out = crs.to_mercator(df).select("lng", "lat", crs.mercator_lng("x").alias("l2"), crs.mercator_lat("y").alias("t2")).collect()
    for r in out:
        assert r.l2 == pytest.approx(r.lng, abs=1e-12)
        assert r.t2 == pytest.approx(r.lat, abs=1e-12)


def test_utm50n_central_meridian(spark):
    # on the central meridian the easting is the false easting exactly
    df = crs.to_utm50n(spark.createDataFrame([(117.0, 40.0)], "lng double, lat double"))
    r = df.first()
    assert r.x == pytest.approx(500000.0, abs=1e-6)
    assert r.y == pytest.approx(4427757.2187, abs=1e-3)


def test_utm_expression_matches_helper(spark):
    df = spark.createDataFrame([(116.3, 39.95), (117.8, 40.4)], "lng double, lat double")
    e, n = crs.utm_xy("lng", "lat")
    a = crs.to_utm50n(df).select("x", "y", e.alias("e"), n.alias("n")).collect()
    for r in a:
        assert r.x == pytest.approx(r.e, abs=1e-6)
        assert r.y == pytest.approx(r.n, abs=1e-6)


def test_gcj_forward_golden_position(spark):
    # a widely published pair: Tiananmen in both systems
    r = crs.wgs84_to_gcj02(spark.createDataFrame([(116.404, 39.915)], "lng double, lat double")).first()
    assert r.gcj_lng == pytest.approx(116.41024449916938, abs=1e-11)
    assert r.gcj_lat == pytest.approx(39.91640428150164, abs=1e-11)


def test_gcj_round_trips_leave_no_residue(spark):
    pts = [(116.2 + i * 0.013, 39.8 + i * 0.007) for i in range(40)] + [(121.47, 31.23), (87.6, 43.8)]
    df = spark.createDataFrame(pts, "lng double, lat double")
    there = crs.gcj02_to_wgs84(crs.wgs84_to_gcj02(df), "gcj_lng", "gcj_lat", "bx", "by").collect()
    assert all(abs(r.bx - r.lng) < 1e-6 and abs(r.by - r.lat) < 1e-6 for r in there)
    back = crs.wgs84_to_gcj02(crs.gcj02_to_wgs84(df), "wgs_lng", "wgs_lat", "fx", "fy").collect()
    assert all(abs(r.fx - r.lng) < 1e-6 and abs(r.fy - r.lat) < 1e-6 for r in back)


def test_gcj_inverse_undoes_forward(spark):
    df = spark.createDataFrame([(116.39, 39.91), (113.26, 23.13)], "lng double, lat double")
    g = crs.wgs84_to_gcj02(df)
    back = crs.gcj02_to_wgs84(g, "gcj_lng", "gcj_lat").collect()
    for r in back:
        assert r.wgs_lng == pytest.approx(r.lng, abs=1e-6)
        assert r.wgs_lat == pytest.approx(r.lat, abs=1e-6)


def test_tile_round_trip_and_truncation(spark):
    df = spark.createDataFrame([(116.39, 39.91, 14)], "lng double, lat double, z int")
    m = crs.to_mercator(df)
    tx, ty = tiles.mercator_to_tile("x", "y", F.col("z"))
    ltx, lty = tiles.latlon_to_tile("lat", "lng", F.col("z"))
    r = m.select(tx.alias("tx"), ty.alias("ty"), ltx.alias("ltx"), lty.alias("lty")).first()
    n = 2 ** 14
    assert r.tx == int((116.39 + 180) / 360 * n)
    assert (r.tx, r.ty) == (r.ltx, r.lty)
    cx, cy = tiles.tile_to_mercator(F.lit(r.tx), F.lit(r.ty), 14)
    lat, lon = tiles.tile_to_latlon(F.lit(r.tx), F.lit(r.ty), 14)
    c = spark.range(1).select(cx.alias("cx"), cy.alias("cy"), lat.alias("lat"), lon.alias("lon"), tiles.tile_url(F.lit(r.tx), F.lit(r.ty), 14).alias("u")).first()
    e = tiles.EQUATOR
    assert c.cx == pytest.approx(r.tx * e / n - e / 2)
    assert c.cy == pytest.approx(e / 2 - r.ty * e / n)
    assert c.lon <= 116.39 < c.lon + 360 / n
    assert c.lat >= 39.91
    assert c.u == f"https://tile.openstreetmap.org/14/{r.tx}/{r.ty}.png"
    # truncation toward zero west of the world square (cast, not floor)
    w = spark.range(1).select(tiles.mercator_to_tile(F.lit(-e / 2 - 1000.0), F.lit(0.0), 2)[0].alias("t")).first()
    assert w.t == 0


def test_pixel_shift_equals_coarser_zoom(spark):
    df = spark.createDataFrame([(12950000.123 + i * 7.77, 4850000.456 - i * 3.3) for i in range(200)], "x double, y double")
    p18x, p18y = tiles.world_pixel("x", "y", 18)
    p12x, p12y = tiles.world_pixel("x", "y", 12)
    rows = df.select(p18x.alias("a"), p18y.alias("b"), p12x.alias("c"), p12y.alias("d")).collect()
    for r in rows:
        assert r.a >> 6 == r.c and r.b >> 6 == r.d


def test_wkt_decode_forms(spark):
    texts = [
        ("POINT (1 2)",),
        ("LINESTRING (0 0, 3 4, 3 8)",),
        ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))",),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",),
        ("LINESTRING (1 2, x y)",),
        ("not wkt",),
    ]
    df = spark.createDataFrame(texts, "t string").select("t", geom.wkt_kind("t").alias("k"), geom.wkt_parts("t").alias("p"))
    rows = {r.t: r for r in df.collect()}
    assert rows["POINT (1 2)"].p == [[(1.0, 2.0)]]
    assert rows["POINT (1 2)"].k == "POINT"
    assert len(rows["LINESTRING (0 0, 3 4, 3 8)"].p[0]) == 3
    poly = rows["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"].p
    assert len(poly) == 2 and len(poly[1]) == 5
    assert len(rows["MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"].p) == 2
    assert rows["LINESTRING (1 2, x y)"].p is None
    assert rows["not wkt"].p is None


def test_measures_and_wkt_round_trip(spark):
    df = spark.createDataFrame(
        [("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))",), ("LINESTRING (0 0, 3 4, 3 8)",)], "t string"
    ).select(geom.wkt_kind("t").alias("k"), geom.wkt_parts("t").alias("p"))
    out = df.select(
        "k",
        geom.polygon_area("p").alias("area"),
        geom.line_length("p").alias("len"),
        geom.envelope("p").alias("env"),
        geom.wkt_parts(geom.to_wkt("k", "p")).alias("p2"),
        "p",
    ).collect()
    poly = [r for r in out if r.k == "POLYGON"][0]
    line = [r for r in out if r.k == "LINESTRING"][0]
    assert poly.area == pytest.approx(96.0)
    assert line.len == pytest.approx(9.0)
    assert tuple(poly.env) == (0.0, 0.0, 10.0, 10.0)
    assert poly.p2 == poly.p and line.p2 == line.p


def test_point_in_polygon_with_hole_and_boundary(spark):
    poly = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
    pts = [(5.0, 5.0, True), (3.0, 3.0, False), (10.0, 5.0, False), (0.0, 0.0, False), (5.0, 0.0, False), (11.0, 5.0, False), (2.0, 3.0, False)]
    df = spark.createDataFrame([(x, y, e, poly) for x, y, e in pts], "x double, y double, expect boolean, t string")
    df = df.withColumn("edges", geom.edges(geom.wkt_parts("t")))
    for r in df.select("x", "y", "expect", geom.within_polygon("x", "y", "edges").alias("got")).collect():
        assert r.got == r.expect, (r.x, r.y)


def test_segment_distance(spark):
    r = spark.range(1).select(
        geom.segment_distance(F.lit(0.0), F.lit(5.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("a"),
        geom.segment_distance(F.lit(4.0), F.lit(3.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"),
        geom.segment_distance(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("c"),
    ).first()
    assert (r.a, r.c) == (5.0, 5.0)
    assert r.b == pytest.approx(math.hypot(3.0, 3.0))


def test_box_contains_line(spark):
    lines = [
        ("LINESTRING (1 1, 2 2)", True),
        ("LINESTRING (0 0, 10 10)", True),  # touches corners, crosses the interior
        ("LINESTRING (0 0, 10 0)", False),  # wholly on the border
        ("LINESTRING (5 5, 11 5)", False),  # leaves the box
    ]
    df = spark.createDataFrame(lines, "t string, e boolean").withColumn("p", geom.wkt_parts("t"))
    got = df.select("e", geom.box_contains_line("p", F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]


def test_time_helpers(spark):
    assert timefn.second_bounds("2024-01-02 06:30:00", "2024-01-03 00:00:00") == (1704177000000, 1704240000000)
    assert timefn.date_bounds("2024-01-02 06:30:00", "2024-01-03 18:00:00") == (1704153600000, 1704240000000)
    # hour slices: first hour whole, ceil((to - from) / 1 h) slices
    assert timefn.hour_slices("2024-01-01 00:30:00", "2024-01-01 02:00:00") == (1704067200000, 1704067200000 + 2 * 3600000)
    # day slices: whole days only, from midnight of the start date
    assert timefn.day_slices("2024-01-01 06:00:00", "2024-01-03 05:00:00") == (1704067200000, 1704067200000 + 86400000)
    ms = 1704067207179  # 2024-01-01 00:00:07.179 UTC
    r = spark.range(1).select(
        timefn.day_of(F.lit(ms)).alias("d"),
        timefn.hour_of_day(F.lit(ms + 8 * 3600000)).alias("h"),
        timefn.day_of(F.lit(ms), offset_ms=-3600000).alias("d_west"),
        F.date_format(timefn.local_timestamp(F.lit(ms)), "yyyy-MM-dd HH:mm:ss").alias("t"),
    ).first()
    assert str(r.d) == "2024-01-01" and r.h == 8 and str(r.d_west) == "2023-12-31"
    assert r.t == "2024-01-01 00:00:07"


def test_staged_utm_parts_equal_point_projection(spark):
    pts = [(116.2 + i * 0.0137, 39.8 + i * 0.0071) for i in range(30)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "lng double, lat double")
    per_point = [(r.x, r.y) for r in crs.to_utm50n(df).collect()]
    parts = spark.createDataFrame([([[{"x": x, "y": y} for x, y in pts]],)], "parts array<array<struct<x:double,y:double>>>")
    staged = parts.select(crs.utm50n_parts("parts").alias("p")).first().p[0]
    assert [(v.x, v.y) for v in staged] == per_point  # bit for bit


def test_time_texts(spark):
    ms = 1704098107179  # 2024-01-01 08:35:07.179 UTC
    r = spark.range(1).select(
        timefn.date_text(F.lit(ms)).alias("d"),
        timefn.time_text(F.lit(ms)).alias("t"),
        timefn.timestamp_text(F.lit(ms), offset_ms=8 * 3600000).alias("ts"),
    ).first()
    assert (r.d, r.t, r.ts) == ("2024-01-01", "08:35:07", "2024-01-01 16:35:07")


def test_wkt_forms(spark):
    good = {
        "POINT Z (1 2 3)": ("POINT", [[(1.0, 2.0)]]),
        "POINTZM(1 2 3 4)": ("POINT", [[(1.0, 2.0)]]),
        "SRID=4326; point ( 1   2 )": ("POINT", [[(1.0, 2.0)]]),
        "LINESTRING EMPTY": ("LINESTRING", []),
        "MULTIPOINT (1 1, 2 2)": ("MULTIPOINT", [[(1.0, 1.0)], [(2.0, 2.0)]]),
        "MULTIPOINT ((1 1), (2 2))": ("MULTIPOINT", [[(1.0, 1.0)], [(2.0, 2.0)]]),
        "MULTILINESTRING ((0 0, 1 1),(2 2,3 3))": ("MULTILINESTRING", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]),
    }
    bad = ["POINT (5)", "LINESTRING (0 0, 1)", "POLYGON ((0 0, 1 1, 1 0, 0 0)", "POLYGON (0 0, 1 1, 1 0, 0 0)", "POINT (1 2, 3 4)", "POINT ((1 2))", "LINESTRING (0 0,, 1 1)",
           "MULTIPOLYGON ((0 0, 1 1, 1 0, 0 0))", "POINT (1 2) x", "POINT", "", "CIRCLE (1 2)", "POINT (1 2 3 4 5)", "POINT (a b)", None]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", geom.wkt_kind("t").alias("k"), geom.wkt_parts("t").alias("p"))
    for r in df.collect():
        if r.t in good:
            assert (r.k, [[tuple(v) for v in p] for p in r.p]) == good[r.t], r.t
        else:
            assert r.p is None, r.t


def test_multi_shapes_areas_members_and_text(spark):
    texts = [
        # areas 1 and 9; then a shell with a hole and an island in the hole, rings in any orientation
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((10 10, 13 10, 13 13, 10 13, 10 10)))", 10.0, 2),
        ("MULTIPOLYGON (((0 0, 0 10, 10 10, 10 0, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2)), ((4 4, 6 4, 6 6, 4 6, 4 4)))", 68.0, 2),
        ("MULTIPOINT ((1 1), (2 2))", None, None),
        ("MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", None, None),
        ("POLYGON EMPTY", 0.0, 0),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in texts], "t string").select("t", geom.wkt_kind("t").alias("k"), geom.wkt_parts("t").alias("p"))
    rows = {r.t: r for r in df.select("t", "k", "p", geom.polygon_area("p").alias("a"), F.size(geom.polygon_members("p")).alias("m"), geom.to_wkt("k", "p", 0).alias("w")).collect()}
    for t, area, members in texts:
        assert rows[t].w == t
        if area is not None:
            assert rows[t].a == pytest.approx(area) and rows[t].m == members
    with_kinds = df.withColumn("n", F.lit(3))
    from pingscape.sinks import writers

    lines = {r.value for r in writers.shape_lines(with_kinds, "k", "p", "n").collect()}
    assert "MULTIPOINT ((1.0 1.0), (2.0 2.0)),3" in lines


def test_one_bad_latitude_leaves_the_envelope(spark):
    from pingscape.operators import aggregate, raster

    good = [(116.3, 39.9), (116.4, 40.0)]
    frames = [crs.to_mercator(spark.createDataFrame(rows, "lng double, lat double")) for rows in (good, [*good, (116.35, 95.0), (116.35, -95.0)])]
    envs = [tuple(aggregate.envelope(f).first()) for f in frames]
    assert envs[0] == envs[1]
    pixels = [sorted(map(tuple, raster.heat_pixels(f, 8, 10).collect())) for f in frames]
    assert pixels[0] == pixels[1]
    offsets = [raster.tile_offsets(aggregate.envelope(f).drop("n"), 10).collect() for f in frames]
    assert offsets[0] == offsets[1]
