"""Grid-cell keys and the keyed join every spatial join is built on.

A spatial predicate (distance, containment) cannot be an equi-join, and a
plain predicate join plans as a nested loop.  Instead both sides get integer
cell keys: the point side one cell (`floor(x * (1 / size))`, same for y), the
shape side every cell its (padded) bounding box or band touches.  An exact predicate
then runs on the candidate pairs.  Every true pair shares the point's cell, and
each (point, shape-row) pair meets in exactly one cell, so no pair is lost and
none is produced twice.

Strategy
--------
* The shape side is the smaller one (POIs, roads, zones, case places).  It is
  broadcast only after one aggregate (row count and summed row widths, combined
  map-side) proved that it has at most `max_broadcast_rows` rows of at most
  `max_broadcast_bytes` bytes in all; the point side then never shuffles.
* Otherwise both sides shuffle on the cell key in a sort-merge join, which can
  spill.  A single cell may hold a large share of all points (a station, a mall):
  adaptive execution splits such a partition from the shuffle statistics, without
  another pass over the points.  Where skew handling is switched off in the session, or
  `salts` asks for it, every key is split over `salts` tasks: a point takes a hash of
  its whole row (stable under recomputation), and the shape rows are copied once
  per salt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.util import col_of


@dataclass(frozen=True)
class JoinPlan:
    """Knobs of the keyed join (defaults sized for a large cluster)."""

    # shape-side rows (after cell explosion) that may be broadcast
    max_broadcast_rows: int = 2_000_000
    # bytes of those rows, text and array columns included
    max_broadcast_bytes: int = 256 << 20
    # force a strategy: None (decide by size), "broadcast", "shuffle"
    force: str | None = None
    # tasks that share one key on the shuffle path; 1 leaves hot keys to adaptive execution
    salts: int = 1


# tasks per key where the session has skew handling switched off
FALLBACK_SALTS = 16

DEFAULT_PLAN = JoinPlan()


def cell_index(v, size: float) -> Column:
    """Integer cell index of a coordinate: floor(v * (1 / size)).

    Both sides use this one monotone function, which is all the cell logic
    needs.  A product (unlike a division) is non-nullable for a non-null
    input; `floor` is nullable, hence the coalesce (it never applies to a
    finite input, and a NaN point cannot satisfy any residual predicate).
    Non-nullable keys mean no `isnotnull` guard is inferred for the join.
    """
    return F.coalesce(F.floor(col_of(v) * F.lit(1.0 / float(size))), F.lit(0).cast("long"))


def with_point_cell(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"cx": cell_index(x, size), "cy": cell_index(y, size)})


def explode_box_cells(
    df: DataFrame, min_x, min_y, max_x, max_y, size: float, pad: float = 0.0
) -> DataFrame:
    """One row per cell touched by the box [min-pad, max+pad] (inclusive).

    `pad` widens the box (a search radius); a tiny relative margin is added so
    rounding in the exact predicate can never produce a pair outside the cells.
    """
    margin = F.lit(float(pad) * (1.0 + 1e-9) + 1e-9 * float(size))
    lo_x = cell_index(col_of(min_x) - margin, size)
    hi_x = cell_index(col_of(max_x) + margin, size)
    lo_y = cell_index(col_of(min_y) - margin, size)
    hi_y = cell_index(col_of(max_y) + margin, size)
    return df.withColumn("cx", F.explode(F.sequence(lo_x, hi_x))).withColumn("cy", F.explode(F.sequence(lo_y, hi_y)))


def _width(t: T.DataType, c: Column) -> Column:
    """Bytes a value takes at most, as an expression (variable types are measured)."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(t, T.StructType):
        out = F.lit(16)
        for f in t.fields:
            out = out + _width(f.dataType, c[f.name])
        return out
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            each = F.aggregate(c, F.lit(0), lambda acc, v: acc + _width(t.elementType, v).cast("int"))
        else:
            each = F.size(c) * 16
        return F.lit(32) + F.coalesce(each, F.lit(0))
    if isinstance(t, T.MapType):
        return F.lit(32) + _width(T.ArrayType(t.keyType), F.map_keys(c)) + _width(T.ArrayType(t.valueType), F.map_values(c))
    return F.lit(16)


def row_width(df: DataFrame) -> Column:
    """Bytes a row of `df` takes at most."""
    out = F.lit(16)
    for f in df.schema.fields:
        out = out + _width(f.dataType, F.col(f"`{f.name}`"))
    return out


def fits(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """True when `df` provably has at most `max_rows` rows and at most `max_bytes`
    bytes.  One aggregate that is combined map-side: a row per task is shuffled."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_width(df).cast("long")).alias("b")).first()
    return r["n"] <= max_rows and (max_bytes is None or (r["b"] or 0) <= max_bytes)


def apart(shapes: DataFrame) -> DataFrame:
    """The rows of a shape table with `shape`, a number of each row's own.

    It is a hash of the row and of its number among equal rows, so a retried task gives a
    row the same number again, wherever the row then lies.  Rows are dealt by it over
    `spark.sql.shuffle.partitions` tasks, so a table in one file is the work of many.
    """
    names = [f"`{c}`" for c in shapes.columns]
    counted = shapes.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    numbered = each.select(*names, F.xxhash64(*names, "_copy").alias("shape"))
    return numbered.repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shape")


def held(df: DataFrame) -> DataFrame:
    """`df` built once for several readers: as a checkpoint where the session names a shared
    folder for them, else cached (a lost part is computed anew)."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _aqe_splits_skew(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    on = lambda k, d: str(conf.get(k, d)).lower() == "true"
    return on("spark.sql.adaptive.enabled", "true") and on("spark.sql.adaptive.skewJoin.enabled", "true")


def keyed_join(points: DataFrame, shapes: DataFrame, keys: list[str], plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Inner equi-join of the point side with the (exploded) shape side on `keys`.

    Returns the joined rows with the key columns kept.  The point side is read once
    on every path.
    """
    mode = plan.force
    if mode is None:
        mode = "broadcast" if fits(shapes, plan.max_broadcast_rows, plan.max_broadcast_bytes) else "shuffle"
    if mode == "broadcast":
        return points.join(F.broadcast(shapes), keys)
    if mode != "shuffle":
        raise ValueError(f"unknown join mode {mode!r}")
    salts = plan.salts if _aqe_splits_skew(points) else max(plan.salts, FALLBACK_SALTS)
    # the hint keeps Spark's size *estimate* from broadcasting a side that the
    # exact check above rejected; a sort-merge join spills on both sides
    if salts <= 1:
        return points.join(shapes.hint("merge"), keys)
    whole_row = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns])
    salted_points = points.withColumn("_salt", F.pmod(whole_row, F.lit(int(salts))).cast("int"))
    salted_shapes = shapes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))))
    return salted_points.join(salted_shapes.hint("merge"), keys + ["_salt"]).drop("_salt")


def segment_band_cells(segs: DataFrame, radius: float, size: float, partition_cols: list[str] | None = None) -> DataFrame:
    """One row per cell within `radius` of a segment's band, for segment rows
    with columns `x1, y1, x2, y2`.

    Cells are generated column by column: in the column [X0, X1] only the part
    of the segment with x in [X0 - r, X1 + r] can be within r of a point of the
    column, so the column's cell range is that part's y-range widened by r.  A
    long diagonal segment therefore yields about (length / size) x (2r / size)
    cells instead of its whole bounding box.  `partition_cols`, if given,
    hash-partitions the column rows (spreads a small line table before the
    per-cell work).
    """
    r = float(radius)
    margin = 1e-9 * float(size) + 1e-6 * r
    cols = segs.withColumn(
        "cx",
        F.explode(
            F.sequence(
                cell_index(F.least("x1", "x2") - r - margin, size), cell_index(F.greatest("x1", "x2") + r + margin, size)
            )
        ),
    )
    if partition_cols:
        cols = cols.repartition(*partition_cols)
    col_x0 = F.col("cx").cast("double") * F.lit(float(size))
    col_x1 = (F.col("cx").cast("double") + 1.0) * F.lit(float(size))
    xa = F.greatest(F.least("x1", "x2"), col_x0 - r)
    xb = F.least(F.greatest("x1", "x2"), col_x1 + r)
    dx = F.col("x2") - F.col("x1")
    slope = (F.col("y2") - F.col("y1")) / dx
    ya = F.when(dx == 0, F.least("y1", "y2")).otherwise(F.col("y1") + (xa - F.col("x1")) * slope)
    yb = F.when(dx == 0, F.greatest("y1", "y2")).otherwise(F.col("y1") + (xb - F.col("x1")) * slope)
    # widen by a relative margin too: the interpolated y carries rounding error
    lo = cell_index(F.least(ya, yb) - r - margin - F.abs(F.least(ya, yb)) * 1e-12, size)
    hi = cell_index(F.greatest(ya, yb) + r + margin + F.abs(F.greatest(ya, yb)) * 1e-12, size)
    return cols.withColumn("cy", F.explode(F.sequence(lo, hi)))
