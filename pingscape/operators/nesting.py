"""Which ring of a multi-polygon lies in which: rings as rows, containment by cell joins.

The rings of a shape arrive in one row and in any order and orientation.  Here every ring
is a row with a point of its inside; a ring surrounds another one if it holds that point
and has the larger area (rings of a shape do not cross).  The rings that can hold a point
are found on a grid of several levels: a ring's box goes to the level whose cells are just
larger, so to a handful of cells, and a point asks at every level.  Whether a ring holds
the point is the parity of the edges right of it; of the ring's edges only those in the
point's band of rows are read.  The depth of a ring is the number of rings around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from .cells import apart, held

MAX_LEVEL = 16


def _rings(named: DataFrame) -> DataFrame:
    """`(feature_id, shape, ring, pts, area, px, py, ...)`: the rings with their boxes, the
    shape's box and number of rings, and a point of the ring's inside (null without area)."""
    rows = named.withColumns({"all": geom.envelope("parts"), "n_rings": F.size("parts")})
    rows = rows.select("feature_id", "shape", "all", "n_rings", F.posexplode("parts").alias("ring", "pts"))
    rows = rows.withColumn("area", F.abs(geom.ring_signed_area2("pts")) / 2.0).withColumn("box", geom.envelope(F.array("pts")))
    # half way between the two lowest heights of the ring lies no vertex
    rows = rows.withColumn("ys", F.array_sort(F.array_distinct(F.transform("pts", lambda p: p["y"]))))
    rows = rows.withColumn("py", (F.try_element_at("ys", F.lit(1)) + F.try_element_at("ys", F.lit(2))) / 2.0)
    met = F.filter(geom.part_edges("pts"), lambda s: (s["y1"] > F.col("py")) != (s["y2"] > F.col("py")))
    rows = rows.withColumn("xs", F.array_sort(F.transform(met, lambda s: s["x1"] + (F.col("py") - s["y1"]) / (s["y2"] - s["y1"]) * (s["x2"] - s["x1"]))))
    rows = rows.withColumn("px", (F.try_element_at("xs", F.lit(1)) + F.try_element_at("xs", F.lit(2))) / 2.0)
    return rows.drop("ys", "xs")


def _levels(n: str):
    """Levels of the grid of a shape with `n` rings: about as many cells as rings on the finest."""
    return F.least(F.lit(MAX_LEVEL), F.ceil(F.log2(F.col(n).cast("double")) / 2.0).cast("int") + 1)


def _cell(v, low, wide, level):
    """Cell of a coordinate on a level: halves of the shape's side, halved `level` times."""
    return F.floor((v - low) / wide * F.pow(F.lit(2.0), level.cast("double")))


def _candidates(rings: DataFrame) -> DataFrame:
    """`(shape, ring, px, py, outer, ...)`: rings with the larger rings of the shape whose box holds their point."""
    wide, high = F.col("all.max_x") - F.col("all.min_x"), F.col("all.max_y") - F.col("all.min_y")
    at = lambda x, y: (_cell(x, F.col("all.min_x"), wide, F.col("level")), _cell(y, F.col("all.min_y"), high, F.col("level")))
    points = rings.select("shape", "ring", "area", "px", "py", "all", F.explode(F.sequence(F.lit(0), _levels("n_rings"))).alias("level"))
    cx, cy = at(F.col("px"), F.col("py"))
    points = points.select("shape", "ring", "area", "px", "py", "level", cx.alias("cx"), cy.alias("cy"))
    share = F.greatest((F.col("box.max_x") - F.col("box.min_x")) / wide, (F.col("box.max_y") - F.col("box.min_y")) / high)
    level = F.greatest(F.lit(0), F.least(_levels("n_rings"), F.floor(-F.log2(share)).cast("int")))
    boxes = rings.withColumn("level", level)
    (lx, ly), (hx, hy) = at(F.col("box.min_x"), F.col("box.min_y")), at(F.col("box.max_x"), F.col("box.max_y"))
    boxes = boxes.withColumn("cx", F.explode(F.sequence(lx, hx))).withColumn("cy", F.explode(F.sequence(ly, hy)))
    boxes = boxes.select("shape", "level", "cx", "cy", F.col("ring").alias("outer"), F.col("area").alias("outer_area"), "box", _bands("pts").alias("bands"))
    pairs = points.join(boxes.hint("merge"), ["shape", "level", "cx", "cy"])
    larger = F.struct("outer_area", "outer") > F.struct(F.col("area").alias("outer_area"), F.col("ring").alias("outer"))
    return pairs.where(larger & geom.within_box("px", "py", *[F.col(f"box.{c}") for c in ("min_x", "min_y", "max_x", "max_y")]))


def _bands(pts: str):
    """Bands of rows that a ring's edges are sorted into."""
    return F.ceil(F.sqrt(F.size(pts).cast("double"))).cast("int")


def _band(y, box: str, bands):
    low, high = F.col(f"{box}.min_y"), F.col(f"{box}.max_y")
    return F.floor((y - low) / (high - low) * bands)


def ring_nesting(polygons: DataFrame) -> DataFrame:
    """`(feature_id, shape, ring, area, depth, parent)` of every ring of `(feature_id, parts)`:
    its number in the row, its area, how many of the row's rings surround it (even: a shell,
    odd: a hole) and the smallest of them (null: none).

    Every row is a shape of its own (`shape` numbers them), also where rows share a
    `feature_id` or have none.  Of two equal rings the first lies in the second.  Rings without
    area, or with a vertex that is null or not finite, surround nothing and have depth 0 (the
    latter a null area); a row without rings gives none.  Rings of a shape must not cross; they
    may touch.
    """
    return _nested(held(apart(polygons.select("feature_id", "parts"))))


def _nested(named: DataFrame) -> DataFrame:
    rings = _rings(named)
    finite = (F.size(F.filter("pts", lambda p: p["x"].isNull() | p["y"].isNull() | ~(F.abs(p["x"]) < 1e300) | ~(F.abs(p["y"]) < 1e300))) == 0)
    rings = held(rings.withColumn("area", F.when(finite, F.col("area"))))
    real = rings.where("area > 0 AND px IS NOT NULL")
    asked = _candidates(real).withColumn("band", _band(F.col("py"), "box", F.col("bands")))
    edges = real.select("shape", F.col("ring").alias("outer"), "box", _bands("pts").alias("bands"), F.explode(geom.part_edges("pts")).alias("e"))
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    edges = edges.where("e.y1 <> e.y2").select(
        "shape", "outer", "e", F.explode(F.sequence(_band(low, "box", F.col("bands")), _band(high, "box", F.col("bands")))).alias("band")
    )
    met = asked.join(edges.hint("merge"), ["shape", "outer", "band"])
    at = F.col("e.x1") + (F.col("py") - F.col("e.y1")) / (F.col("e.y2") - F.col("e.y1")) * (F.col("e.x2") - F.col("e.x1"))
    crossed = ((F.col("e.y1") > F.col("py")) != (F.col("e.y2") > F.col("py"))) & (F.col("px") < at)
    around = met.where(crossed).groupBy("shape", "ring", "outer").agg(F.count(F.lit(1)).alias("n"), F.first("outer_area").alias("outer_area"))
    around = around.where("n % 2 = 1").groupBy("shape", "ring").agg(
        F.count(F.lit(1)).alias("depth"), F.min_by("outer", F.struct("outer_area", "outer")).alias("parent")
    )
    out = rings.select("feature_id", "shape", "ring", "area").join(around, ["shape", "ring"], "left")
    return out.select("feature_id", "shape", "ring", "area", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "parent")


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """`(feature_id, kind, n_rings, n_members, area)` of `(feature_id, kind, parts)`: members are
    the rings of even depth with an area; the area is theirs less that of the others.  A row
    without rings has none and area 0."""
    named = held(apart(polygons.select("feature_id", "kind", "parts")))
    nested = _nested(named.select("feature_id", "shape", "parts"))
    shell = F.col("depth") % 2 == 0
    sums = nested.groupBy("shape").agg(
        F.count(F.lit(1)).cast("int").alias("n_rings"), F.count_if(shell & (F.col("area") > 0)).cast("int").alias("n_members"),
        F.sum(F.when(shell, F.col("area")).otherwise(-F.col("area"))).alias("area"),
    )
    out = named.select("feature_id", "kind", "shape").join(sums, "shape", "left")
    return out.select("feature_id", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rings", "n_members")], F.coalesce("area", F.lit(0.0)).alias("area"))
