"""Minimal shapefile writer for test fixtures (polylines / polygons / points
with text attributes), following the published ESRI layout."""

from __future__ import annotations

import struct


def _box(points):
    xs = [p[0] for p in points] or [0.0]
    ys = [p[1] for p in points] or [0.0]
    return min(xs), min(ys), max(xs), max(ys)


def _content(shape_type, parts):
    if shape_type == 1:
        (x, y) = parts[0][0]
        return struct.pack("<i2d", 1, x, y)
    pts = [p for part in parts for p in part]
    starts, n = [], 0
    for part in parts:
        starts.append(n)
        n += len(part)
    body = struct.pack("<i4d2i", shape_type, *_box(pts), len(parts), len(pts))
    body += struct.pack(f"<{len(parts)}i", *starts)
    body += b"".join(struct.pack("<2d", x, y) for x, y in pts)
    return body


def _header(shape_type, file_words, box):
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, file_words) + struct.pack("<2i", 1000, shape_type) + struct.pack("<8d", *box, 0, 0, 0, 0)


def write_layer(base: str, shape_type: int, records: list[tuple[list, dict]]):
    """records: [(parts, {field: text})]; parts = [[(x, y), ...], ...]."""
    contents = [_content(shape_type, parts) for parts, _ in records]
    all_pts = [p for parts, _ in records for part in parts for p in part]
    box = _box(all_pts)
    shp_body, shx_body, offset = b"", b"", 50
    for i, c in enumerate(contents):
        words = len(c) // 2
        shp_body += struct.pack(">2i", i + 1, words) + c
        shx_body += struct.pack(">2i", offset, words)
        offset += 4 + words
    with open(base + ".shp", "wb") as f:
        f.write(_header(shape_type, 50 + len(shp_body) // 2, box) + shp_body)
    with open(base + ".shx", "wb") as f:
        f.write(_header(shape_type, 50 + len(shx_body) // 2, box) + shx_body)
    fields = sorted({k for _, a in records for k in a})
    widths = {k: max([len(str(a.get(k, ""))) for _, a in records] + [1]) for k in fields}
    header_len = 32 + 32 * len(fields) + 1
    record_len = 1 + sum(widths.values())
    head = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(records), header_len, record_len)
    desc = b"".join(struct.pack("<11sc4xBB14x", k.encode()[:11], b"C", widths[k], 0) for k in fields)
    rows = b"".join(b" " + b"".join(str(a.get(k, "")).ljust(widths[k]).encode() for k in fields) for _, a in records)
    with open(base + ".dbf", "wb") as f:
        f.write(head + desc + b"\r" + rows + b"\x1a")
