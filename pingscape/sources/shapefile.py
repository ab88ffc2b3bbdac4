"""Shapefile reader as a Spark Python data source (`format("shapefile")`).

A layer is a `.shp` (geometry records), `.shx` (fixed-size index: offset and
length of every record) and `.dbf` (fixed-width attribute table).  The reader's
partitions are byte ranges of the `.shp`: a task finds its first and last record by
bisecting the index, so a few long records weigh as much as many short ones,
and each task reads only its own ranges of the three files.  Paths may be any URI
that pyarrow's file systems open (local, hdfs, s3, gs, ...), a layer or a folder of
layers.  Records are decoded into Arrow batches.

Output schema::

    file string, record long, kind string,
    parts array<array<struct<x double, y double>>>, attrs map<string, string>

`kind` is POINT, MULTIPOINT, LINESTRING, MULTILINESTRING, POLYGON or
MULTIPOLYGON (polygons whose clockwise shells number more than one); Z and M
variants are read as planar.  `attrs` holds the dBASE fields as text.  Records whose
attribute row is marked deleted are skipped; a null shape has a null kind and no parts.

Usage::

    register_shapefile_source(spark)
    df = spark.read.format("shapefile").option("bytesPerPartition", 64 << 20).load(path)
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "file string, record long, kind string, "
    "parts array<array<struct<x: double, y: double>>>, attrs map<string, string>"
)
BYTES_PER_PARTITION = 64 << 20
BATCH_BYTES = 4 << 20

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema(
    [("file", pa.string()), ("record", pa.int64()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(_POINT))), ("attrs", pa.map_(pa.string(), pa.string()))]
)

# Shapefile shape type codes (plain, Z and M variants).
POINT_TYPES = {1, 11, 21}
MULTIPOINT_TYPES = {8, 18, 28}
LINE_TYPES = {3, 13, 23}
POLYGON_TYPES = {5, 15, 25}


class ByteRange(InputPartition):
    """Records of one layer that begin in [start, stop) of its `.shp`."""

    def __init__(self, shp: str, start: int, stop: int):
        super().__init__((shp, start, stop))
        self.shp, self.start, self.stop = shp, start, stop


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, for a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _layer_files(files: fs.FileSystem, path: str) -> list[str]:
    if files.get_file_info(path).type == fs.FileType.Directory:
        return sorted(i.path for i in files.get_file_info(fs.FileSelector(path)) if i.path.lower().endswith(".shp"))
    return [path]


def _sibling(files: fs.FileSystem, shp: str, ext: str) -> str | None:
    for e in (ext, ext.upper()):
        if files.get_file_info(shp[:-4] + e).type == fs.FileType.File:
            return shp[:-4] + e
    return None


def _at(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    return f.read(n)


class _Index:
    """The `.shx`: begin and length of every record, by number."""

    def __init__(self, f, size: int):
        self._f, self.count = f, max(0, (size - 100) // 8)

    def begin(self, record: int) -> int:
        return struct.unpack(">i", _at(self._f, 100 + 8 * record, 4))[0] * 2

    def first_at(self, position: int) -> int:
        """Number of the first record that begins at `position` or later."""
        lo, hi = 0, self.count
        while lo < hi:
            mid = (lo + hi) // 2
            if self.begin(mid) < position:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def entries(self, lo: int, hi: int) -> np.ndarray:
        """(begin, content length) in bytes of records lo .. hi - 1."""
        return np.frombuffer(_at(self._f, 100 + 8 * lo, 8 * (hi - lo)), ">i4").reshape(-1, 2).astype(np.int64) * 2


def _clockwise(xy: np.ndarray) -> bool:
    x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) < 0


def decode_shape(buf: bytes) -> tuple[str | None, np.ndarray, np.ndarray]:
    """(kind, coordinates n x 2, first vertex of each part) of one record's content."""
    (code,) = struct.unpack_from("<i", buf)
    none = np.zeros((0, 2)), np.zeros(0, np.int64)
    if code == 0:
        return None, *none
    if code in POINT_TYPES:
        return "POINT", np.frombuffer(buf, "<f8", 2, 4).reshape(1, 2), np.zeros(1, np.int64)
    if code in MULTIPOINT_TYPES:
        (n,) = struct.unpack_from("<i", buf, 36)
        return "MULTIPOINT", np.frombuffer(buf, "<f8", 2 * n, 40).reshape(n, 2), np.arange(n)
    if code in LINE_TYPES or code in POLYGON_TYPES:
        n_parts, n = struct.unpack_from("<2i", buf, 36)
        first = np.frombuffer(buf, "<i4", n_parts, 44).astype(np.int64)
        xy = np.frombuffer(buf, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
        if code in LINE_TYPES:
            return ("LINESTRING" if n_parts == 1 else "MULTILINESTRING"), xy, first
        shells = sum(_clockwise(r) for r in np.split(xy, first[1:]) if len(r))  # shells are clockwise
        return ("MULTIPOLYGON" if shells > 1 else "POLYGON"), xy, first
    raise ValueError(f"unsupported shape type {code}")


class _Attributes:
    """Random access to the fixed-width dBASE table; without a file every record has no attributes."""

    def __init__(self, f, encoding: str):
        self._f, self._encoding, self.fields = f, encoding, []
        if f is None:
            return
        head = _at(f, 0, 32)
        self._begin, self._width = struct.unpack_from("<HH", head, 8)
        desc = _at(f, 32, self._begin - 32)
        for i in range(0, len(desc) - 31, 32):
            if desc[i] == 0x0D:
                break
            self.fields.append((desc[i : i + 11].split(b"\x00")[0].decode("ascii", "replace"), desc[i + 16]))

    def rows(self, lo: int, hi: int) -> list[dict[str, str] | None]:
        """Attributes of records lo .. hi - 1; None for a deleted one."""
        if self._f is None:
            return [{}] * (hi - lo)
        data, out = _at(self._f, self._begin + lo * self._width, (hi - lo) * self._width), []
        for k in range(hi - lo):
            row = data[k * self._width : (k + 1) * self._width]
            if row[:1] == b"*":
                out.append(None)
                continue
            values, at = {}, 1  # byte 0 is the deletion flag
            for name, width in self.fields:
                values[name] = row[at : at + width].decode(self._encoding, "replace").strip()
                at += width
            out.append(values)
        return out


def _batch(shp: str, records: list[int], shapes: list, attrs: list[dict[str, str]]) -> pa.RecordBatch:
    """Rows as one Arrow batch; the nested parts are built from offsets."""
    xy = np.concatenate([s[1] for s in shapes]) if shapes else np.zeros((0, 2))
    base, part_begin, rows = 0, [], [0]
    for _, points, first in shapes:
        part_begin.extend((first + base).tolist())
        rows.append(len(part_begin))
        base += len(points)
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], fields=list(_POINT))
    rings = pa.ListArray.from_arrays(pa.array([*part_begin, base], pa.int32()), points)
    parts = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), rings)
    columns = [pa.array([shp] * len(records), pa.string()), pa.array(records, pa.int64()), pa.array([s[0] for s in shapes], pa.string()), parts, pa.array([list(a.items()) for a in attrs], _ARROW.field("attrs").type)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.per_partition = int(options.get("bytesPerPartition", BYTES_PER_PARTITION))
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self):
        files, path = _open_fs(self.path)
        out = []
        for shp in _layer_files(files, path):
            size = files.get_file_info(shp).size
            out += [ByteRange(shp, at, at + self.per_partition) for at in range(100, size, self.per_partition)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        files, _ = _open_fs(self.path)
        shx, dbf = _sibling(files, partition.shp, ".shx"), _sibling(files, partition.shp, ".dbf")
        with files.open_input_file(shx) as fx, files.open_input_file(partition.shp) as fs_, (files.open_input_file(dbf) if dbf else pa.BufferReader(b"")) as fd:
            index, attributes = _Index(fx, files.get_file_info(shx).size), _Attributes(fd if dbf else None, self.encoding)
            at, stop = index.first_at(partition.start), index.first_at(partition.stop)
            while at < stop:
                entries = index.entries(at, min(stop, at + 4096))
                ends = np.cumsum(entries[:, 1] + 8)
                n = max(1, int(np.searchsorted(ends, BATCH_BYTES, side="right")))
                rows = attributes.rows(at, at + n)
                live = [k for k in range(n) if rows[k] is not None]
                shapes = [decode_shape(_at(fs_, int(entries[k, 0]) + 8, int(entries[k, 1]))) for k in live]
                if live:
                    yield _batch(partition.shp, [at + k for k in live], shapes, [rows[k] for k in live])
                at += n


class ShapefileDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)


def register_shapefile_source(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileDataSource)


def read_shapes(spark: SparkSession, path: str, id_field: str | None = None, bytes_per_partition: int = BYTES_PER_PARTITION):
    """Read a layer as `(feature_id, kind, parts, attrs)`.

    `feature_id` is the attribute `id_field` as text when given (`ID`, `OID_`, ...),
    otherwise the record number as text.
    """
    from pyspark.sql import functions as F

    register_shapefile_source(spark)
    df = spark.read.format("shapefile").option("bytesPerPartition", bytes_per_partition).load(path)
    fid = F.col("attrs")[id_field] if id_field else F.col("record").cast("string")
    return df.select(fid.alias("feature_id"), "kind", "parts", "attrs")
