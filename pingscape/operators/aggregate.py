"""Aggregations over join results and pings.

All counts are partial (map-side) aggregates before the shuffle, so a hot
feature or a hot day never lands whole in one task.  Distinct counts use
Spark's two-level expansion (dedupe on (key, value) first, then count), which
also spreads a hot key over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crs import finite
from ..functions.timefn import MS_PER_HOUR, day_of, epoch_hour, hour_start


def count_by_day(pairs: DataFrame, key: str = "feature_id", name: str = "join_count", offset_ms: int = 0, ts: str = "sys_time") -> DataFrame:
    """`COUNT(*)` per (key, day of the ping)."""
    return pairs.groupBy(key, day_of(ts, offset_ms).alias("day")).agg(F.count(F.lit(1)).alias(name))


def window_stats(pairs: DataFrame, key: str = "feature_id") -> DataFrame:
    """Per matched window: `n` pairs, `n_distinct` distinct point positions."""
    return pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.col("x"), F.col("y")).alias("n_distinct"),
    )


def positions(points: DataFrame, *keys: str) -> DataFrame:
    """Points collapsed to one row per position (and `keys`), with their number as `weight`."""
    return points.groupBy("x", "y", *keys).agg(F.count(F.lit(1)).alias("weight"))


def stats_per_window(points: DataFrame, shapes: DataFrame, join, key: str = "feature_id", count=None) -> DataFrame:
    """`window_stats` of `join(points, shapes)` with the aggregation before the join.

    Points are collapsed to positions first, combined map-side, so a (position, window)
    pair occurs once: `n` sums the weights and `n_distinct` counts the pairs, with no distinct over
    pairs and one exchange of a partial row per window and task.  Only where shape rows share a
    key (asked of the shape side by one small aggregate) may a position meet a key
    twice; there the positions of a key are told apart.  `count(positions, shapes)`, if given, is asked
    instead of `join` where no key is shared: the same rows, counted without pairs.
    """
    shared = not shapes.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty()
    if count is not None and not shared:
        return count(positions(points), shapes)
    pairs = join(positions(points), shapes)
    distinct = F.count_distinct(F.col("x"), F.col("y")) if shared else F.count(F.lit(1))
    return pairs.groupBy(key).agg(F.sum("weight").alias("n"), distinct.alias("n_distinct"))


def with_density(stats: DataFrame, area) -> DataFrame:
    """`density = n_distinct / area`; `area` is a column or a constant."""
    a = area if not isinstance(area, (int, float)) else F.lit(float(area))
    return stats.withColumn("area", a).withColumn("density", F.col("n_distinct") / F.col("area"))


def top_windows(stats: DataFrame, k: int, by: str = "density", key: str = "feature_id") -> DataFrame:
    """The `k` windows with the largest `by`; ties broken by key (deterministic).

    Planned as TakeOrderedAndProject: every task keeps its own top k, and only
    k rows per task reach the final merge.
    """
    return stats.orderBy(F.col(by).desc(), F.col(key).asc()).limit(int(k))


def envelope(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: min / max of x and y over the points with finite coordinates, and their count."""
    good = finite(x, y)
    of = lambda c: F.when(good, F.col(c))
    return df.agg(
        F.min(of(x)).alias("min_x"),
        F.min(of(y)).alias("min_y"),
        F.max(of(x)).alias("max_x"),
        F.max(of(y)).alias("max_y"),
        F.count(of(x)).alias("n"),
    )


def grid_cell_index(v, lo: float, hi: float, n: int):
    """Equal-width bin 0..n-1 over [lo, hi]; the upper edge belongs to the last bin."""
    return F.least(
        F.lit(n - 1), F.floor((F.col(v) - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(n)).cast("int")
    )


def hourly_grid(
    pings: DataFrame,
    box: tuple[float, float, float, float],
    cells_per_axis: int,
    lo_ms: int,
    hi_ms: int,
    offset_ms: int = 0,
    lng: str = "lng",
    lat: str = "lat",
) -> DataFrame:
    """Pings per equal-grid cell and hour, zero cells included for every hour
    that has at least one ping in its time slice.

    Hour slices are open at both ends, so pings exactly on the hour are dropped.
    Every ping is binned to (hour, cell), with cell -1 for pings outside the box
    (they still make their hour present), and counted with a map-side combine.
    The full grid of the hours present is generated and left-joined to the counts
    on (hour, cell): work grows with hours x cells, and no row holds more than one cell.
    Both sides start from the same aggregate, whose exchange is reused.
    """
    min_lng, min_lat, max_lng, max_lat = box
    n = int(cells_per_axis)
    p = pings.where((F.col("sys_time") > lo_ms) & (F.col("sys_time") < hi_ms))
    p = p.where(F.pmod(F.col("sys_time") + F.lit(int(offset_ms)), F.lit(MS_PER_HOUR)) != 0)
    in_box = F.col(lng).between(min_lng, max_lng) & F.col(lat).between(min_lat, max_lat)
    cell = grid_cell_index(lng, min_lng, max_lng, n) * F.lit(n) + grid_cell_index(lat, min_lat, max_lat, n)
    binned = p.select(
        epoch_hour("sys_time", offset_ms).alias("hour"),
        F.when(in_box, cell).otherwise(F.lit(-1)).alias("cell"),
    )
    counts = binned.groupBy("hour", "cell").agg(F.count(F.lit(1)).alias("c"))
    hours = counts.groupBy("hour").agg(F.sum("c").alias("total")).where("total > 0")
    grid = hours.select("hour", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("cell"))
    out = grid.join(counts, ["hour", "cell"], "left").select(
        "hour",
        (F.col("cell") / F.lit(n)).cast("int").alias("cell_i"),
        F.pmod(F.col("cell"), F.lit(n)).alias("cell_j"),
        F.coalesce("c", F.lit(0).cast("long")).alias("number_of_records"),
    )
    w_lng = (max_lng - min_lng) / n
    w_lat = (max_lat - min_lat) / n
    return out.select(
        hour_start("hour").alias("hour_start"),
        "cell_i",
        "cell_j",
        (F.lit(float(min_lng)) + F.col("cell_i") * F.lit(w_lng)).alias("min_lng"),
        (F.lit(float(min_lat)) + F.col("cell_j") * F.lit(w_lat)).alias("min_lat"),
        (F.lit(float(min_lng)) + (F.col("cell_i") + 1) * F.lit(w_lng)).alias("max_lng"),
        (F.lit(float(min_lat)) + (F.col("cell_j") + 1) * F.lit(w_lat)).alias("max_lat"),
        "number_of_records",
    )
