"""Readers, writers and SQL functions (round trips through scratch folders)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pingscape.functions import crs
from pingscape.functions.sql import register_sql_functions
from pingscape.sinks import writers
from pingscape.sources import csv as csv_src
from pingscape.sources import fixtures

SF001 = "/root/testdata/sf0.001"


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="pingscape-test-")


def _write_text(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_read_points_drops_bad_rows_and_keeps_columns(spark, scratch):
    p = os.path.join(scratch, "pings", "part.csv")
    _write_text(
        p,
        [
            "id,lng,lat,sysTime,tag",
            "1,116.30000000000001,39.9,1704067207179,a",
            "2,abc,39.9,1704067207179,b",  # text in lng -> dropped
            "3,116.31,39.91,notatime,c",  # bad time -> dropped
            "4,116.32,39.92,1704067300000,d",
        ],
    )
    df = csv_src.read_points(spark, os.path.dirname(p))
    lost = {r.corrupt_record: r.reason for r in csv_src.rejected_points(spark, os.path.dirname(p)).collect()}
    assert lost == {"2,abc,39.9,1704067207179,b": "lng", "3,116.31,39.91,notatime,c": "sys_time"}
    rows = sorted(df.collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == ["1", "4"]
    assert rows[0].lng == pytest.approx(116.3) and rows[0].sys_time == 1704067207179 and rows[0].tag == "a"
    assert dict(df.dtypes)["lng"] == "double" and dict(df.dtypes)["sys_time"] == "bigint"


def test_read_by_ordinal_and_cases(spark, scratch):
    p = os.path.join(scratch, "named", "a.csv")
    _write_text(p, ["39.9,116.4,Tiananmen,x", "40.0,116.3,Haidian,y", "bad,116.0,Nowhere,z"])
    df = csv_src.read_points_by_ordinal(spark, os.path.dirname(p), lon_col=1, lat_col=0, name_col=2)
    got = sorted((r.name, r.lng, r.lat) for r in df.collect())
    assert got == [("Haidian", 116.3, 40.0), ("Tiananmen", 116.4, 39.9)]
    c = os.path.join(scratch, "cases", "c.csv")
    _write_text(c, ["date,lng,lat", "2024-01-05,116.3,39.9", "bad-date,116.3,39.9"])
    cases = csv_src.read_cases(spark, os.path.dirname(c)).collect()
    assert len(cases) == 1 and str(cases[0].case_date) == "2024-01-05"
    assert [tuple(r) for r in csv_src.rejected_cases(spark, os.path.dirname(c)).collect()] == [("bad-date,116.3,39.9", "case_date")]
    assert [r.reason for r in csv_src.rejected_points_by_ordinal(spark, os.path.dirname(p), lon_col=1, lat_col=0).collect()] == ["lat"]


def test_point_layer_gcj_and_mercator(spark, scratch):
    p = os.path.join(scratch, "g", "a.csv")
    _write_text(p, ["lng,lat", "116.40,39.91"])
    plain = csv_src.load_point_layer(spark, os.path.dirname(p), mercator=False).first()
    assert (plain.x, plain.y) == (116.4, 39.91)
    g = csv_src.load_point_layer(spark, os.path.dirname(p), gcj_input=True).first()
    assert g.lng < 116.40 and g.lat < 39.91  # the GCJ shift is removed
    assert g.x == pytest.approx(6378137.0 * 3.141592653589793 / 180 * g.lng)


def test_writers_round_trip(spark, scratch):
    pings = fixtures.pings(spark, SF001).withColumn("day", F.to_date(F.timestamp_millis("sys_time")))
    out = os.path.join(scratch, "by_day")
    writers.write_partitioned(pings.select("ping_id", "day"), out, "day")
    days = sorted(d for d in os.listdir(out) if d.startswith("day="))
    assert len(days) == pings.select("day").distinct().count()
    back = spark.read.option("header", True).csv(out)
    assert back.count() == pings.count()

    small = os.path.join(scratch, "top")
    writers.write_small(pings.orderBy("ping_id"), small)
    files = [f for f in os.listdir(small) if f.endswith(".csv")]
    # every row is written, however many there are
    assert len(files) == 1 and spark.read.option("header", True).csv(small).count() == pings.count()

    shapes = fixtures.roads_lnglat(spark, SF001).withColumn("n", F.lit(3))
    txt = os.path.join(scratch, "wkt")
    writers.write_text_lines(writers.shape_lines(shapes, "kind", "parts", "n"), txt, F.col("value"))
    lines = spark.read.text(txt).collect()
    assert len(lines) == 25 and all(r.value.startswith("LINESTRING (") and r.value.endswith(",3") for r in lines)

    tiles = spark.createDataFrame([(9, 1, 2, 3), (10, 4, 5, 6)], "z int, tx int, ty int, n int")
    tdir = os.path.join(scratch, "tiles")
    writers.write_tiles(tiles, tdir)
    assert sorted(d for d in os.listdir(tdir) if d.startswith("z=")) == ["z=10", "z=9"]


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(116.39, 39.91)], "lng double, lat double")
    df.createOrReplaceTempView("pt")
    s = spark.sql(
        "SELECT mercator_x(lng) AS x, mercator_y(lat) AS y, wgs_to_gcj_lng(lng, lat) AS gl, wgs_to_gcj_lat(lng, lat) AS gt,"
        " tile_x(mercator_x(lng), 14) AS tx, tile_y(mercator_y(lat), 14) AS ty,"
        " planar_distance(0D, 0D, 3D, 4D) AS d FROM pt"
    ).first()
    c = crs.wgs84_to_gcj02(crs.to_mercator(df)).first()
    assert s.x == pytest.approx(c.x) and s.y == pytest.approx(c.y)
    assert s.gl == pytest.approx(c.gcj_lng, abs=1e-12) and s.gt == pytest.approx(c.gcj_lat, abs=1e-12)
    inverse = spark.sql("SELECT gcj_to_wgs_lng(lng, lat) AS a, gcj_to_wgs_lat(lng, lat) AS b FROM pt").first()
    w = crs.gcj02_to_wgs84(df).first()
    assert (inverse.a, inverse.b) == (w.wgs_lng, w.wgs_lat)
    ring = "array(array(named_struct('x',0D,'y',0D), named_struct('x',4D,'y',0D), named_struct('x',4D,'y',4D), named_struct('x',0D,'y',4D), named_struct('x',0D,'y',0D)))"
    r = spark.sql(
        f"SELECT shape_within(1D, 1D, {ring}) a, shape_within(4D, 1D, {ring}) b, shape_within(5D, 1D, {ring}) c,"
        f" shape_contains_box(-1D, -1D, 5D, 5D, {ring}) d, shape_contains_box(-1D, -1D, 3D, 5D, {ring}) e, shape_near(4.5D, 1D, 1D, {ring}) f"
    ).first()
    assert tuple(r) == (True, False, False, True, False, True)
    assert s.d == 5.0 and s.tx == int((116.39 + 180) / 360 * 2**14)
    assert "BatchEvalPython" not in spark.sql("SELECT mercator_x(lng) FROM pt")._jdf.queryExecution().executedPlan().toString()


def test_hot_partition_value_is_written_by_several_tasks(spark, scratch):
    rows = [("2024-01-01", i) for i in range(3000)] + [("2024-01-02", i) for i in range(30)]
    df = spark.createDataFrame(rows, "day string, v long")
    out = os.path.join(scratch, "hot")
    # a small advisory size stands for a large input
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        writers.write_partitioned(df.repartition(6), out, "day", spread=["v"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    hot_files = [f for f in os.listdir(os.path.join(out, "day=2024-01-01")) if f.endswith(".csv")]
    assert len(hot_files) > 1
    assert spark.read.option("header", True).csv(out).count() == 3030


def test_run_cli_writes_results(spark, scratch):
    from pingscape import run

    out = os.path.join(scratch, "fishnet")
    run.main(["zone_counts_by_day", "/root/testdata/sf0.001", out, "--partition-by", "day"])
    days = [d for d in os.listdir(out) if d.startswith("day=")]
    assert days
    back = spark.read.option("header", True).csv(out)
    assert set(back.columns) == {"feature_id", "join_count", "day"}
    out2 = os.path.join(scratch, "visits")
    run.main(["poi_visits_by_day", "/root/testdata/sf0.001", out2, "--format", "parquet"])
    assert spark.read.parquet(out2).columns == ["feature_id", "day", "join_count"]


def test_point_layer_envelope(spark, scratch):
    p = os.path.join(scratch, "env", "a.csv")
    _write_text(p, ["lng,lat", "116.0,39.0", "117.0,40.0", "bad,1"])
    layer, env = csv_src.load_point_layer_with_envelope(spark, os.path.dirname(p), mercator=False)
    e = env.first()
    assert (e.min_x, e.min_y, e.max_x, e.max_y, e.n) == (116.0, 39.0, 117.0, 40.0, 2)
    assert layer.count() == 2


def test_windows_with_their_points(spark, tmp_path):
    from pingscape.sinks.writers import write_window_points

    # window 2 holds nearly all pairs, each position several times
    rows = [(2, float(i % 997), float(i % 991)) for i in range(20000)] + [(1, 3.0, 4.0), (1, 3.0, 4.0), (None, 0.5, 0.5), (3, None, 1.0)]
    pairs = spark.createDataFrame(rows, "feature_id long, x double, y double").repartition(5)
    write_window_points(pairs, str(tmp_path / "points"))
    files = sorted((tmp_path / "points").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    spots = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] or -1, r[1], r[2]))
    assert lines == [f"{'' if k is None else k},POINT ({x} {y})" for k, x, y in spots]
    # the large window is spread over several files, and a task's file is a small part of it
    held = [sum(line.startswith("2,") for line in f.read_text().splitlines()) for f in files]
    assert sum(n > 0 for n in held) > 2 and max(held) < 0.6 * sum(held)
    write_window_points(pairs.limit(0), str(tmp_path / "none"))
    assert not [line for f in (tmp_path / "none").glob("part-*") for line in f.read_text().splitlines()]
