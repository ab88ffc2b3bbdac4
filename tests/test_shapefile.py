"""Shapefile data source: record ranges, geometry kinds, attributes."""

import os
import tempfile

from pyspark.sql import functions as F

from pingscape.operators import joins
from pingscape.plans import inputs
from pingscape.sources.shapefile import read_shapes

from .shapefile_writer import write_layer

SF01 = "/root/testdata/sf0.01"


def test_read_lines_and_polygons(spark):
    d = tempfile.mkdtemp(prefix="pingscape-shp-")
    roads = inputs.roads_mercator(spark, SF01).orderBy("feature_id").collect()
    write_layer(
        os.path.join(d, "roads"),
        3,
        [([[(v.x, v.y) for v in part] for part in r.parts], {"ID": str(r.feature_id), "NAME": f"road {r.feature_id}"}) for r in roads],
    )
    got = read_shapes(spark, os.path.join(d, "roads.shp"), id_field="ID", bytes_per_partition=500)
    size = os.path.getsize(os.path.join(d, "roads.shp"))
    assert got.rdd.getNumPartitions() == -(-(size - 100) // 500) > 4  # byte ranges
    got = got.withColumn("feature_id", F.col("feature_id").cast("long"))
    rows = {r.feature_id: r for r in got.collect()}
    assert set(rows) == {r.feature_id for r in roads}
    for r in roads:
        g = rows[r.feature_id]
        assert g.kind == "LINESTRING" and g.attrs["NAME"] == f"road {r.feature_id}"
        assert [[(v.x, v.y) for v in p] for p in g.parts] == [[(v.x, v.y) for v in p] for p in r.parts]

    # the layer read from the file joins exactly like the generated one
    pings = inputs.only(inputs.pings_mercator(spark, SF01), "ping_id", "x", "y")
    a = joins.near_lines(pings, inputs.roads_mercator(spark, SF01), 300.0).select("ping_id", "feature_id")
    b = joins.near_lines(pings, got.select("feature_id", "kind", "parts"), 300.0).select("ping_id", "feature_id")
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 608

    zones = inputs.zones_mercator(spark, SF01).orderBy("feature_id").collect()
    # shapefile shells are clockwise: write each hexagon ring reversed, with a hole in zone 0
    recs = []
    for z in zones:
        ring = [(v.x, v.y) for v in z.parts[0]][::-1]
        parts = [ring]
        if z.feature_id == 0:
            cx = sum(p[0] for p in ring[:-1]) / 6
            cy = sum(p[1] for p in ring[:-1]) / 6
            parts.append([(cx - 10, cy - 10), (cx + 10, cy - 10), (cx + 10, cy + 10), (cx - 10, cy + 10), (cx - 10, cy - 10)])
        recs.append((parts, {"OID_": str(z.feature_id)}))
    write_layer(os.path.join(d, "zones"), 5, recs)
    zs = read_shapes(spark, "file://" + os.path.join(d, "zones.shp"), id_field="OID_").withColumn("feature_id", F.col("feature_id").cast("long"))
    kinds = {r.feature_id: (r.kind, len(r.parts)) for r in zs.collect()}
    assert kinds[0] == ("POLYGON", 2) and kinds[1] == ("POLYGON", 1)
    hits_file = joins.in_polygons(pings, zs.select("feature_id", "kind", "parts")).where(F.col("feature_id") != 0).count()
    hits_gen = joins.in_polygons(pings, inputs.zones_mercator(spark, SF01)).where(F.col("feature_id") != 0).count()
    assert hits_file == hits_gen


def test_points_and_directory(spark):
    d = tempfile.mkdtemp(prefix="pingscape-shp-")
    write_layer(os.path.join(d, "a"), 1, [([[(1.0, 2.0)]], {"N": "x"}), ([[(3.0, 4.0)]], {"N": "y"})])
    write_layer(os.path.join(d, "b"), 1, [([[(5.0, 6.0)]], {"N": "z"})])
    df = read_shapes(spark, d)
    rows = sorted((r.attrs["N"], r.kind, r.parts[0][0].x) for r in df.collect())
    assert rows == [("x", "POINT", 1.0), ("y", "POINT", 3.0), ("z", "POINT", 5.0)]


def test_text_ids_and_deleted_records(spark):
    d = tempfile.mkdtemp(prefix="pingscape-shp-")
    write_layer(os.path.join(d, "r"), 3, [([[(0.0, i), (1.0, i)]], {"ID": f"R-{i}"}) for i in range(5)])
    with open(os.path.join(d, "r.dbf"), "r+b") as f:
        data = f.read()
        header, width = int.from_bytes(data[8:10], "little"), int.from_bytes(data[10:12], "little")
        f.seek(header + 2 * width)
        f.write(b"*")  # record 2 is marked deleted
    df = read_shapes(spark, os.path.join(d, "r.shp"), id_field="ID", bytes_per_partition=100)
    assert sorted(r.feature_id for r in df.collect()) == ["R-0", "R-1", "R-3", "R-4"]


def test_multi_polygon_from_a_file(spark):
    from pingscape.functions import geom

    d = tempfile.mkdtemp(prefix="pingscape-shp-")
    square = lambda x, s: [(x, 0.0), (x, s), (x + s, s), (x + s, 0.0), (x, 0.0)]  # clockwise
    write_layer(os.path.join(d, "m"), 5, [([square(0.0, 1.0), square(10.0, 3.0)], {"ID": "a"})])
    r = read_shapes(spark, os.path.join(d, "m.shp"), id_field="ID").select("kind", geom.polygon_area("parts").alias("a"), geom.to_wkt("kind", "parts", 0).alias("w")).first()
    assert (r.kind, r.a) == ("MULTIPOLYGON", 10.0) and r.w.startswith("MULTIPOLYGON (((0 0")
