"""CSV point readers.

Ping / POI / case files are CSV with every value as text.  The readers never
infer a schema (no extra pass over the data): with a header, column names come
from the first line and every column is a string; coordinates and times are
converted with `try_cast`.  A row whose coordinate or time does not parse could
never join anything and is not returned by the readers; the `rejected_*` readers
return exactly those rows, each with its text as `corrupt_record` and what did
not parse as `reason`, to be written or counted beside the result.  Other columns
pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import gcj02_to_wgs84, to_mercator

# coordinates are read through this decimal type, as the input files state them
COORD_DECIMAL = "decimal(24,14)"
COORD_DECIMAL_ORDINAL = "decimal(24,18)"


def _coord(c: str, decimal: str = COORD_DECIMAL) -> F.Column:
    return F.col(c).try_cast(decimal).cast("double")


def _parsed(raw: DataFrame, cols: dict[str, F.Column], corrupt: bool) -> DataFrame:
    """`raw` with the parsed columns: the rows where all of them parsed, or with
    `corrupt` the others as (corrupt_record, reason)."""
    df = raw.withColumns(cols)
    parsed = F.lit(True)
    for c in cols:
        parsed = parsed & F.col(c).isNotNull()
    if not corrupt:
        return df.where(parsed)
    reason = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    text = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))
    # the reason is taken from the parsed columns, the record from the text that was read
    return raw.select(text.alias("corrupt_record"), *[e.alias(f"_p_{c}") for c, e in cols.items()]).withColumnsRenamed({f"_p_{c}": c for c in cols}).where(~parsed).select("corrupt_record", reason.alias("reason"))


def _points(spark, path, lng, lat, time, header, delimiter, corrupt) -> DataFrame:
    raw = spark.read.option("header", header).option("delimiter", delimiter).option("mode", "PERMISSIVE").csv(path)
    cols = {"lng": _coord(lng), "lat": _coord(lat)}
    if time is not None:
        cols["sys_time"] = F.col(time).try_cast("bigint")
    return _parsed(raw, cols, corrupt)


def read_points(
    spark: SparkSession,
    path: str,
    lng: str = "lng",
    lat: str = "lat",
    time: str | None = "sysTime",
    header: bool = True,
    delimiter: str = ",",
) -> DataFrame:
    """Pings / POIs from CSV with a header.

    Returns every input column plus `lng`, `lat` (double) and, when `time` is
    given, `sys_time` (epoch ms, bigint).
    """
    return _points(spark, path, lng, lat, time, header, delimiter, False)


def rejected_points(
    spark: SparkSession,
    path: str,
    lng: str = "lng",
    lat: str = "lat",
    time: str | None = "sysTime",
    header: bool = True,
    delimiter: str = ",",
) -> DataFrame:
    """The rows that `read_points` leaves out: `corrupt_record`, `reason`."""
    return _points(spark, path, lng, lat, time, header, delimiter, True)


def _ordinals(spark, path, lon_col, lat_col, time_col, delimiter, corrupt) -> DataFrame:
    raw = spark.read.option("header", False).option("delimiter", delimiter).csv(path)
    cols = {
        "lng": _coord(f"_c{lon_col}", COORD_DECIMAL_ORDINAL),
        "lat": _coord(f"_c{lat_col}", COORD_DECIMAL_ORDINAL),
    }
    if time_col is not None:
        cols["sys_time"] = F.col(f"_c{time_col}").try_cast("bigint")
    return _parsed(raw, cols, corrupt)


def read_points_by_ordinal(
    spark: SparkSession,
    path: str,
    lon_col: int,
    lat_col: int,
    name_col: int | None = 2,
    time_col: int | None = None,
    delimiter: str = ",",
) -> DataFrame:
    """Headerless CSV; coordinates (and optionally a name and epoch-ms time) by
    column ordinal.  Output: `lng`, `lat`, [`name`], [`sys_time`] and the raw `_cN`."""
    df = _ordinals(spark, path, lon_col, lat_col, time_col, delimiter, False)
    return df if name_col is None else df.withColumn("name", F.col(f"_c{name_col}"))


def rejected_points_by_ordinal(spark: SparkSession, path: str, lon_col: int, lat_col: int, time_col: int | None = None, delimiter: str = ",") -> DataFrame:
    """The rows that `read_points_by_ordinal` leaves out: `corrupt_record`, `reason`."""
    return _ordinals(spark, path, lon_col, lat_col, time_col, delimiter, True)


def _cases(spark, path, date, lng, lat, corrupt) -> DataFrame:
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    day = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date")
    return _parsed(raw, {"lng": _coord(lng), "lat": _coord(lat), "case_date": day}, corrupt)


def read_cases(spark: SparkSession, path: str, date: str = "date", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Infected places: `case_date` (from 'yyyy-MM-dd' text), `lng`, `lat`."""
    return _cases(spark, path, date, lng, lat, False)


def rejected_cases(spark: SparkSession, path: str, date: str = "date", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """The rows that `read_cases` leaves out: `corrupt_record`, `reason`."""
    return _cases(spark, path, date, lng, lat, True)


def load_point_layer(
    spark: SparkSession,
    path: str,
    lng: str = "lng",
    lat: str = "lat",
    time: str | None = None,
    mercator: bool = True,
    gcj_input: bool = False,
) -> DataFrame:
    """CSV -> optional GCJ-02 correction -> point -> optional Web-Mercator.

    The composed point loader: positions given in GCJ-02 are shifted back to
    WGS-84 first; with `mercator=False` the planar coordinates stay in degrees
    (and any radius used with them is in degrees too).  Output adds `x`, `y`.
    """
    df = read_points(spark, path, lng, lat, time)
    if gcj_input:
        df = gcj02_to_wgs84(df, "lng", "lat", "_wl", "_wt").drop("lng", "lat").withColumnsRenamed({"_wl": "lng", "_wt": "lat"})
    if mercator:
        return to_mercator(df)
    return df.withColumns({"x": F.col("lng"), "y": F.col("lat")})


def load_point_layer_with_envelope(spark: SparkSession, path: str, **kwargs) -> tuple[DataFrame, DataFrame]:
    """`load_point_layer` plus its envelope: a one-row frame with min / max of
    x and y and the point count (one aggregate, combined map-side)."""
    from ..operators.aggregate import envelope

    layer = load_point_layer(spark, path, **kwargs)
    return layer, envelope(layer)
