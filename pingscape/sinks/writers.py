"""Result writers.

Every writer is a DataFrame write executed by the tasks; nothing is gathered
on the driver.  Results that are small by construction (a count, a top-k) can be
written as a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV directory, header row, overwrite."""
    df.write.mode("overwrite").option("header", header).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str | list[str], header: bool = True, fmt: str = "csv", spread: list[str] | None = None) -> None:
    """One sub-directory per value of `by` (e.g. one per day or per hour).

    Rows are rebalanced by `by` (and by `spread`, columns with many values): small
    values share tasks, and a value that holds a large share of the rows is split
    by size, so the number of its files follows the data.
    """
    cols = [by] if isinstance(by, str) else list(by)
    w = df.hint("rebalance", *[F.col(c) for c in cols + (spread or [])]).write.mode("overwrite").partitionBy(*cols)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def write_text_lines(df: DataFrame, path: str, line) -> None:
    """One text line per row (e.g. a WKT shape with its counts)."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def shape_lines(df: DataFrame, kind: str = "kind", parts: str = "parts", *values: str) -> DataFrame:
    """`wkt,value1,value2,...` text per shape row."""
    items = [geom.to_wkt(kind, parts)] + [F.col(v).cast("string") for v in values]
    # a missing value leaves its field empty, so that the fields keep their places
    return df.select(F.concat_ws(",", *[F.coalesce(i, F.lit("")) for i in items]).alias("value"))


def window_point_lines(pairs: DataFrame, key: str = "feature_id") -> DataFrame:
    """`id,POINT (x y)` text: every window with each of its distinct positions, one line a
    pair, windows in order and their positions by x, then y.

    Pairs are ranged over the tasks by (window, x, y), not by window, and sorted inside: a
    window with a large share of all pings is the work of several tasks, whose files follow
    one another, and no list of a window's points is ever held.  A missing id leaves its
    field empty and comes first; pairs without a position are no points.
    """
    spots = pairs.select(key, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = spots.repartitionByRange(tasks, key, "x", "y").sortWithinPartitions(key, "x", "y")
    point = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    return ordered.select(F.concat_ws(",", F.coalesce(F.col(key).cast("string"), F.lit("")), point).alias("value"))


def write_window_points(pairs: DataFrame, path: str, key: str = "feature_id") -> None:
    """`window_point_lines` as text files, in order by their names."""
    window_point_lines(pairs, key).write.mode("overwrite").text(path)


def write_small(df: DataFrame, path: str, header: bool = True) -> None:
    """A result that is small by construction (a count, a top-k) as one CSV file; all its rows are written."""
    df.coalesce(1).write.mode("overwrite").option("header", header).csv(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """Tile / pixel tables as parquet partitioned by zoom, each zoom spread by its tiles."""
    tiles = [c for c in ("tx", "ty") if c in df.columns] or [c for c in ("px", "py") if c in df.columns]
    write_partitioned(df, path, "z", fmt="parquet", spread=tiles)
