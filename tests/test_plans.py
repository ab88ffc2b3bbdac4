"""Registered analyses: equal to the brute-force DuckDB oracle at sf0.01,
sane physical plans, anchor values, and the driver entry points."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pingscape.plans import catalog, colocation, inputs, oracle, tilemaps
from pingscape.plans import params as P

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"


def _norm(v):
    # floats compare exactly: the oracle evaluates the same operations in the same order
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    cols = sorted(df.columns)
    got = _rows([r.asDict() for r in df.collect()], cols)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    want = _rows([dict(zip(dcols, r)) for r in res.fetchall()], cols)
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.all_sql())
    assert set(oracle.all_sql()) <= set(E.oracle_sql()) and set(catalog.QUERIES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["feature_id", "day", "join_count"]
    assert df.count() > 0


SPATIAL = [
    "poi_visits_by_day",
    "poi_window_stats",
    "case_exposure_by_day",
    "pois_near_cases",
    "zone_counts_by_day",
    "zone_totals",
    "labeled_zone_hour8",
    "road_pings",
    "road_visits_by_day",
]


@pytest.mark.parametrize("name", SPATIAL)
def test_spatial_joins_are_equi_joins(spark, name):
    plan = E.queries()[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "HashJoin" in plan


def _explain(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_time_filter_reaches_the_scan(spark):
    plan = _explain(E.queries()["poi_visits_by_day"](spark, SF01))
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters") and "ts" in line]
    assert pushed and "GreaterThanOrEqual(ts," in pushed[0] and "LessThan(ts," in pushed[0]


def test_scan_reads_only_needed_columns(spark):
    plan = _explain(E.queries()["poi_visits_by_day"](spark, SF01))
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in schemas[0]


def test_anchor_values(spark):
    p = inputs.pings_mercator(spark, SF01)
    s = p.agg(F.sum("sys_time"), F.min("sys_time"), F.max("sys_time")).first()
    assert tuple(s) == (17053619445353579, 1704067207179, 1706659032194)
    road = colocation.road_pings(spark, SF01).agg(F.sum("n")).first()[0]
    assert road == 608
    from pingscape.operators import filters

    assert filters.within_study_area(p).count() == 3172
    assert filters.at_hour(p, 8).count() == 418
    tiles = tilemaps.heat_tiles(spark, SF01)
    assert tiles.count() > 0


def test_zone_hits_anchor(spark):
    from pingscape.operators import joins

    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y")
    hits = joins.in_polygons(pings, inputs.zones_mercator(spark, SF01))
    assert hits.count() == 2586
    assert hits.select("feature_id").distinct().count() == 25


def test_heat_mass_before_blur_equals_ping_count(spark):
    from pingscape.operators import raster

    pings = inputs.pings_mercator(spark, SF01).select("x", "y")
    counts = raster.pixel_counts(pings, P.MIN_ZOOM, P.MAX_ZOOM)
    per_zoom = {r.z: r.s for r in counts.groupBy("z").agg(F.sum("n").alias("s")).collect()}
    assert set(per_zoom) == set(range(P.MIN_ZOOM, P.MAX_ZOOM + 1))
    assert all(v == 10000 for v in per_zoom.values())


def test_heat_blur_keeps_mass_inside_span(spark):
    # with a huge span nothing is clipped, so blurred mass = 9 x count per zoom
    from pingscape.operators import raster

    pings = inputs.pings_mercator(spark, SF01).select("x", "y")
    spans = raster.tile_spans(raster.box_envelope(spark, (-2.0e7, -2.0e7, 2.0e7, 2.0e7)), 10, 10)
    pix = raster.heat_pixels(pings, 10, 10, blur=1, cap=2.0, spans=spans)
    s = pix.agg(F.sum("n_sum"), F.max("intensity"), F.min("intensity")).first()
    assert s[0] == 9 * 10000
    assert s[1] <= 1.0 and s[2] > 0


def test_tile_table_anchor(spark):
    pix = tilemaps.heat_pixels(spark, SF01)
    raw = pix.where(F.col("n_sum") > 0)
    assert raw.count() > 0
    zooms = sorted(r.z for r in tilemaps.heat_tiles(spark, SF01).select("z").distinct().collect())
    assert zooms == list(range(P.MIN_ZOOM, P.MAX_ZOOM + 1))


def test_smoke_scale_runs(spark):
    for name, q in catalog.QUERIES.items():
        assert q(spark, SF001).count() >= 0, name


def test_pyramid_methods_agree(spark):
    from pingscape.operators import raster

    pings = inputs.pings_mercator(spark, SF001).select("x", "y")
    a = sorted(map(tuple, raster.pixel_counts(pings, 3, 12, method="explode").collect()))
    b = sorted(map(tuple, raster.pixel_counts(pings, 3, 12, method="rollup").collect()))
    assert a == b


def test_results_do_not_depend_on_session_zone_or_timestamp_type(spark):
    import __spark_entry__ as E2

    def snapshot():
        p = inputs.pings_mercator(spark, SF01)
        agg = tuple(p.agg(F.sum("sys_time"), F.min("sys_time"), F.max("sys_time")).first())
        flag = sorted(map(tuple, E2.queries()["poi_visits_by_day"](spark, SF01).collect()))
        return agg, flag

    base = snapshot()
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    old_ntz = spark.conf.get("spark.sql.parquet.inferTimestampNTZ.enabled")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
        assert spark.read.parquet(f"{SF01}/events.parquet").schema["ts"].dataType.typeName() == "timestamp"
        assert snapshot() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", old_ntz)
    assert base[0] == (17053619445353579, 1704067207179, 1706659032194)


def test_heat_map_reads_the_pings_once(spark):
    """The spans and the pixels come from one aggregate: its exchange runs once."""
    df = tilemaps.heat_pixels(spark, SF01)
    rows = df.count()
    df2 = tilemaps.heat_pixels(spark, SF01)
    df2.collect()
    text = df2._jdf.queryExecution().executedPlan().toString()
    assert rows > 0 and "Reused" in text and text.split("== Initial Plan ==")[0].count("FileScan parquet") <= 1


def test_starred_rows_filter_something(spark):
    q = catalog.QUERIES
    n = inputs.pings_mercator(spark, SF01).count()
    assert 0 < q["wide_winter_pings"](spark, SF01).count() < n
    roads = inputs.wide_roads_mercator(spark, SF01).count()
    assert 0 < q["wide_lines_in_box"](spark, SF01).count() < roads
    assert q["wide_heat_tiles"](spark, SF01).count() > q["wide_heat_tiles_beijing"](spark, SF01).count() > 0
    grid = q["wide_hourly_grid_counts"](spark, SF01)
    hours = grid.select("hour_start").distinct().count()
    assert 0 < hours < 45 * 24
    inside = grid.agg(F.sum("number_of_records")).first()[0]
    assert 0 < inside < n
    blocks = q["block_totals"](spark, SF01)
    assert 0 < blocks.count()


def test_scale_of_derived_shapes(spark):
    for layer in (inputs.wide_roads_mercator, inputs.blocks_mercator):
        assert layer(spark, SF01).count() > layer(spark, SF001).count()


def test_road_queries_of_supplier_size_grow(spark):
    q = catalog.QUERIES
    assert q["wide_segment_capsules"](spark, SF01).count() > q["wide_segment_capsules"](spark, SF001).count() > 0
    for name in ("wide_road_tile_offsets", "wide_road_tile_spans"):
        assert q[name](spark, SF01).count() == q[name.replace("wide_", "")](spark, SF01).count()


@pytest.mark.parametrize("name", ["poi_window_stats", "zone_totals", "road_pings", "block_totals"])
def test_windows_need_no_distinct_over_pairs(spark, name):
    """Positions are collapsed before the join: no expansion for a distinct count, and after the join one
    exchange of partial rows per window."""
    plan = E.queries()[name](spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    assert "weight" in plan and "sum(weight" in plan
