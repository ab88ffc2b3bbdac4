"""Heat-map and line rasters over slippy-map tiles, all zoom levels in one job.

Pixels are global (`px`, `py` at 256 pixels per tile side), so the tile of a
pixel is `px div 256`.  The image of a zoom level is limited to its *tile
span*: the tiles covering the data envelope (or a fixed box) at that zoom.

Heat map
--------
1. Pixel counts at the finest zoom only: one scan of the points, one partial /
   final aggregate on (px, py).
2. Coarser zooms come from that table by a right shift (exact: Mercator pixel
   coordinates at zoom z - k are those at z scaled by 2^-k, and floor commutes
   with that scaling).  The finest-level table is exploded to every zoom and
   re-aggregated; a hot pixel is combined map-side before any shuffle.
3. The tile spans of the data follow from the smallest and largest tile of that same
   table (tiles are pixels shifted right), so the points are read once; a fixed box
   gives its spans without reading them.
4. The counts are dealt by tile, each tile with the pixels up to b beyond its edge, over as
   many tasks as the pixels ask for (`BLUR_PIXELS` each), and blurred there with a (2b+1)^2
   mean, with no further exchange: a task's memory does not grow with the input.  Pixels
   outside the zoom's span are dropped, the rest capped and scaled to [0, 1].

Line map
--------
Each segment is stepped uniformly along its longer pixel axis, per zoom.  Its steps are
first clipped to the zoom's span (two linear inequalities, solved for the step number and
widened by a step), then cut into ranges of at most `STEP_RANGE` steps, which are dealt over
the tasks as rows; only then pixels are made, tested exactly and counted.  A line across a
continent thus costs its steps inside the span, and no array holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.crs import finite
from ..functions.tiles import EQUATOR, TILE_PIXELS, mercator_to_tile, tile_to_mercator, world_pixel

# steps of a segment that one row stands for, a power of two
STEP_RANGE = 4096
# counted pixels that one task blurs
BLUR_PIXELS = 1 << 17


def tile_offsets(env: DataFrame, max_zoom: int) -> DataFrame:
    """Top-left tile `(z, tx, ty)` of the envelope at zooms 0..max_zoom.

    `env` is a one-row frame with min_x, min_y, max_x, max_y (Mercator).
    """
    e = env.select("min_x", "max_y").withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(int(max_zoom)))))
    tx, ty = mercator_to_tile("min_x", "max_y", F.col("z"))
    return e.select("z", tx.alias("tx"), ty.alias("ty"))


def tile_spans(env: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Per zoom: the tiles covering the envelope and their aligned Mercator box.

    Columns: z, tx0, ty0, tx1, ty1, scale_x, scale_y, min_x, min_y, max_x, max_y.
    The far corner is one tile past the last covered tile, so the box is
    aligned to tile edges.
    """
    e = env.select("min_x", "min_y", "max_x", "max_y").withColumn(
        "z", F.explode(F.sequence(F.lit(int(min_zoom)), F.lit(int(max_zoom))))
    )
    tx0, ty0 = mercator_to_tile("min_x", "max_y", F.col("z"))
    tx1, ty1 = mercator_to_tile("max_x", "min_y", F.col("z"))
    e = e.select("z", tx0.alias("tx0"), ty0.alias("ty0"), tx1.alias("tx1"), ty1.alias("ty1"))
    bx0, by1 = tile_to_mercator("tx0", "ty0", F.col("z"))
    bx1, by0 = tile_to_mercator(F.col("tx1") + 1, F.col("ty1") + 1, F.col("z"))
    return e.select(
        "z",
        "tx0",
        "ty0",
        "tx1",
        "ty1",
        (F.col("tx1") - F.col("tx0") + 1).alias("scale_x"),
        (F.col("ty1") - F.col("ty0") + 1).alias("scale_y"),
        bx0.alias("min_x"),
        by0.alias("min_y"),
        bx1.alias("max_x"),
        by1.alias("max_y"),
    )


def box_envelope(spark, box: tuple[float, float, float, float]) -> DataFrame:
    """A fixed Mercator box as a one-row envelope frame."""
    return spark.createDataFrame([tuple(float(v) for v in box)], "min_x double, min_y double, max_x double, max_y double")


def _inside_span(px: str = "px", py: str = "py"):
    t = TILE_PIXELS
    return (
        (F.col(px) >= F.col("tx0") * t)
        & (F.col(px) < (F.col("tx1") + 1) * t)
        & (F.col(py) >= F.col("ty0") * t)
        & (F.col(py) < (F.col("ty1") + 1) * t)
    )


def _with_spans(df: DataFrame, spans: DataFrame) -> DataFrame:
    # one row per zoom level: its size is bounded by the zoom range (<= 31 rows)
    return df.join(F.broadcast(spans.select("z", "tx0", "ty0", "tx1", "ty1")), "z")


def pixel_counts(
    points: DataFrame, min_zoom: int, max_zoom: int, x: str = "x", y: str = "y", method: str = "explode"
) -> DataFrame:
    """`(z, px, py, n)` raw point counts per pixel for every zoom in the range
    (points without finite coordinates are on no pixel).

    Both methods aggregate the points once, at the finest zoom.
    `explode`: that table is copied to every zoom and re-aggregated in one
    shuffle (map-side combine collapses the coarse zooms early).
    `rollup`: every coarser zoom is aggregated from the one below it, so each
    level reads a table at most a quarter of the previous one (about 1.33 x the
    finest table in total), at the price of one stage per zoom level.
    """
    px, py = world_pixel(x, y, int(max_zoom))
    # counted with weight 0 rather than filtered: a filter on projected coordinates would be
    # pushed below the projection and evaluate it again
    seen = points.select(px.cast("long").alias("px"), py.cast("long").alias("py"), finite(x, y).cast("long").alias("here"))
    finest = seen.groupBy("px", "py").agg(F.sum("here").alias("n")).where("n > 0")
    if method == "rollup":
        level = finest
        levels = [finest.select(F.lit(int(max_zoom)).alias("z"), "px", "py", "n")]
        for z in range(int(max_zoom) - 1, int(min_zoom) - 1, -1):
            level = level.groupBy(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py")).agg(
                F.sum("n").alias("n")
            )
            levels.append(level.select(F.lit(z).alias("z"), "px", "py", "n"))
        out = levels[0]
        for lv in levels[1:]:
            out = out.unionByName(lv)
        return out
    if method != "explode":
        raise ValueError(f"unknown method {method!r}")
    levels = finest.withColumn("z", F.explode(F.sequence(F.lit(int(min_zoom)), F.lit(int(max_zoom)))))
    levels = levels.select(
        "z",
        F.expr(f"shiftright(px, {int(max_zoom)} - z)").alias("px"),
        F.expr(f"shiftright(py, {int(max_zoom)} - z)").alias("py"),
        "n",
    )
    return levels.groupBy("z", "px", "py").agg(F.sum("n").alias("n"))


def spans_of_pixels(counts: DataFrame) -> DataFrame:
    """Per zoom, the tiles that hold the pixels of a `(z, px, py, n)` table."""
    # the test on n keeps this branch's aggregate equal to the table's own, so its exchange is reused
    seen = counts.where("n > 0")
    tile = lambda f, c: F.floor(f(c) / TILE_PIXELS).cast("int")
    return seen.groupBy("z").agg(tile(F.min, "px").alias("tx0"), tile(F.min, "py").alias("ty0"), tile(F.max, "px").alias("tx1"), tile(F.max, "py").alias("ty1"))


def _blur_tasks(points: DataFrame, zooms: int, max_zoom: int) -> int:
    """Tasks for the blur: by the points' number of pixels at the finest zoom (estimated), on every zoom."""
    px, py = world_pixel("x", "y", int(max_zoom))
    pixels = points.agg(F.approx_count_distinct(F.struct(px.cast("long"), py.cast("long")))).first()[0]
    return max(1, math.ceil(pixels * zooms / BLUR_PIXELS))


def _blurred(counts: DataFrame, blur: int, tasks: int) -> DataFrame:
    """Sum of the (2 * blur + 1)^2 neighbours of every pixel, tile by tile."""
    tile = lambda c: F.floor(c / TILE_PIXELS)
    reached = lambda c: F.explode(F.sequence(tile(F.col(c) - blur), tile(F.col(c) + blur)))
    dealt = counts.withColumn("bx", reached("px")).withColumn("by", reached("py")).repartition(tasks, "z", "bx", "by")

    def own(c: str, t: str):
        """The pixels of the tile that the pixel is a neighbour of."""
        first = F.col(t) * TILE_PIXELS
        return F.explode(F.sequence(F.greatest(F.col(c) - blur, first), F.least(F.col(c) + blur, first + (TILE_PIXELS - 1))))

    near = dealt.withColumn("px", own("px", "bx")).withColumn("py", own("py", "by"))
    # grouped by the tile too: the rows are already dealt by it
    return near.groupBy("z", "bx", "by", "px", "py").agg(F.sum("n").alias("n")).drop("bx", "by")


def heat_pixels(
    points: DataFrame,
    min_zoom: int,
    max_zoom: int,
    blur: int = 1,
    cap: float = 2.0,
    spans: DataFrame | None = None,
    method: str = "explode",
) -> DataFrame:
    """Blurred heat-map pixels inside each zoom's tile span (`spans`, or the span of the data).

    Columns: z, px, py, n_sum (points in the (2b+1)^2 neighbourhood),
    value = n_sum / (2b+1)^2, intensity = min(value, cap) / cap.
    """
    counts = pixel_counts(points, min_zoom, max_zoom, method=method)
    b = int(blur)
    blurred = counts
    if spans is None:
        spans = spans_of_pixels(counts)
    else:
        blurred = _with_spans(counts, spans).where(_inside_span()).select("z", "px", "py", "n")
    if b > 0:
        blurred = _blurred(blurred, b, _blur_tasks(points, int(max_zoom) - int(min_zoom) + 1, max_zoom))
        blurred = _with_spans(blurred, spans).where(_inside_span())
    blurred = blurred.select("z", "px", "py", F.col("n").alias("n_sum"))
    area = float((2 * b + 1) ** 2)
    value = F.col("n_sum") / F.lit(area)
    return blurred.select(
        "z",
        "px",
        "py",
        "n_sum",
        value.alias("value"),
        (F.least(value, F.lit(float(cap))) / F.lit(float(cap))).alias("intensity"),
    )


def assemble_tiles(pixels: DataFrame, weight: str = "n_sum", value: str = "intensity") -> DataFrame:
    """Non-empty tiles of a pixel table: pixel count, summed weight, largest value.

    The tile table is what a renderer needs to decide which images to draw;
    it is partitioned by zoom when written (see `sinks.writers.write_tiles`).
    """
    t = TILE_PIXELS
    return pixels.groupBy(
        "z", F.floor(F.col("px") / t).cast("int").alias("tx"), F.floor(F.col("py") / t).cast("int").alias("ty")
    ).agg(
        F.count(F.lit(1)).alias("n_pixels"),
        F.sum(weight).alias("total"),
        F.max(value).alias("peak"),
    )


def line_pixels(lines: DataFrame, spans: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """`(z, px, py, hits)` pixels touched by the line segments, inside the span (segments
    with a vertex that is null or not finite touch none)."""
    segs = lines.select("feature_id", F.explode(geom.edges("parts")).alias("s")).where(finite("s.x1", "s.y1") & finite("s.x2", "s.y2"))
    segs = segs.withColumn("z", F.explode(F.sequence(F.lit(int(min_zoom)), F.lit(int(max_zoom)))))
    scale = F.pow(F.lit(2.0), F.col("z")) * float(TILE_PIXELS)
    half = F.lit(EQUATOR / 2.0)
    eq = F.lit(EQUATOR)
    segs = segs.select(
        "feature_id",
        "z",
        ((F.col("s.x1") + half) / eq * scale).alias("fx1"),
        ((half - F.col("s.y1")) / eq * scale).alias("fy1"),
        ((F.col("s.x2") + half) / eq * scale).alias("fx2"),
        ((half - F.col("s.y2")) / eq * scale).alias("fy2"),
    )
    steps = F.greatest(
        F.abs(F.floor("fx2") - F.floor("fx1")), F.abs(F.floor("fy2") - F.floor("fy1"))
    )
    ranges = _step_ranges(_with_spans(segs.withColumn("steps", steps), spans), max_zoom)
    pix = ranges.withColumn("t", F.explode(F.sequence("t0", "t1")))
    denom = F.greatest(F.col("steps"), F.lit(1).cast("long")).cast("double")
    pix = pix.select(
        "z", "tx0", "ty0", "tx1", "ty1",
        F.floor(F.col("fx1") + (F.col("fx2") - F.col("fx1")) * F.col("t") / denom).alias("px"),
        F.floor(F.col("fy1") + (F.col("fy2") - F.col("fy1")) * F.col("t") / denom).alias("py"),
    )
    return pix.where(_inside_span()).groupBy("z", "px", "py").agg(F.count(F.lit(1)).alias("hits"))


def _clipped_steps(start: str, end: str, low: str, high: str) -> tuple[F.Column, F.Column]:
    """Steps of a segment that can have their pixel in tiles `low` to `high` along one axis,
    widened so that rounding loses none: (first, last), the first after the last if none."""
    at, d = F.col(start), F.col(end) - F.col(start)
    slack = F.lit(1e-6) + F.abs(at) * 1e-12
    a = F.col(low).cast("double") * TILE_PIXELS - slack - at
    b = (F.col(high).cast("double") + 1) * TILE_PIXELS + slack - at
    whole = F.col("steps").cast("double")
    denom = F.greatest(whole, F.lit(1.0))
    # a segment that hardly moves along this axis is inside for all its steps or for none
    still = F.abs(d) < 1e-9
    inside = (a <= 0) & (b >= 0)
    first = F.when(still, F.when(inside, 0.0).otherwise(whole + 1)).otherwise(F.least(a / d, b / d) * denom - 1)
    last = F.when(still, F.when(inside, whole).otherwise(-1.0)).otherwise(F.greatest(a / d, b / d) * denom + 1)
    bounded = lambda v: F.greatest(F.lit(-1.0), F.least(whole + 1, v))
    return F.floor(bounded(first)), F.ceil(bounded(last))


def _step_ranges(segs: DataFrame, max_zoom: int) -> DataFrame:
    """Segments in pixels with their zoom's span, as rows of at most `STEP_RANGE` steps
    (`t0` to `t1`) that can fall into the span."""
    x, y = _clipped_steps("fx1", "fx2", "tx0", "tx1"), _clipped_steps("fy1", "fy2", "ty0", "ty1")
    zero = F.lit(0).cast("long")
    out = segs.withColumns({"t0": F.greatest(zero, x[0], y[0]), "t1": F.least(F.col("steps"), x[1], y[1])}).where("t0 <= t1")
    # cut by powers of the range, so that the list of cuts is bounded too
    bits = STEP_RANGE.bit_length() - 1
    depth = max(2, math.ceil((int(max_zoom) + math.log2(TILE_PIXELS)) / bits))
    for level in range(depth - 1, 0, -1):
        size = F.lit(STEP_RANGE**level).cast("long")
        out = out.withColumn("cut", F.explode(F.expr(f"sequence(t0 div {STEP_RANGE**level}L, t1 div {STEP_RANGE**level}L)")))
        out = out.withColumns({"t0": F.greatest("t0", F.col("cut") * size), "t1": F.least("t1", (F.col("cut") + 1) * size - 1)}).drop("cut")
    return out.repartition("z", "fx1", "fy1", "t0")


def lines_in_box(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Lines wholly contained in the box (see `geom.box_contains_line`)."""
    min_x, min_y, max_x, max_y = (F.lit(float(v)) for v in box)
    return lines.where(geom.box_contains_line("parts", min_x, min_y, max_x, max_y))
