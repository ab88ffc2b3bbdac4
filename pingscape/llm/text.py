"""Words, lines and hashes of whole Arrow text batches, as numpy arrays.

A word is a run of bytes other than the six ASCII white-space characters
(`[^\\x20\\x09-\\x0D]+`).  All helpers work on a slice of documents held as one
byte buffer with offsets, so the cost per word is a few vector operations, and
memory is bounded by the slice (`slices`) whatever the batch holds; a text longer
than a slice is a slice of its own.  Hashes depend on content alone and are the
same on every executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19
LONG_SPAN = 1 << 14

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for every offset inside a block."""
    if not _powers:
        n = BLOCK_BYTES + LONG_SPAN + 1
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for b in (_BASE, inverse):
            t = np.full(n, b, dtype=np.uint64)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (spreads every input bit)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def give_back() -> None:
    """Return this worker's freed memory to the system at a task's end: an idle worker otherwise keeps what its allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [lo, hi) of at most `max_bytes` (or one longer row), with their bytes and offsets."""
    buf, offs = raw(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words: byte spans, and the index of each document's first word (n + 1 entries)."""
    inside = ~_SPACE[buf]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    heads = offs[:-1][offs[:-1] < len(buf)]
    before[heads] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    after[tails] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans come in order of their starts."""
    out = np.empty(len(start), dtype=np.uint64)
    power, inverse = _power_tables()
    length = end - start
    i = 0
    while i < len(start):
        if length[i] > LONG_SPAN:
            out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
            i += 1
            continue
        j = int(np.searchsorted(start, start[i] + BLOCK_BYTES, side="left"))
        longer = np.flatnonzero(length[i:j] > LONG_SPAN)
        if len(longer):
            j = i + int(longer[0])
        b0, b1 = int(start[i]), int(end[i:j].max())
        x = buf[b0:b1].astype(np.uint64)
        x += np.uint64(1)
        x *= power[: b1 - b0]
        total = np.zeros(b1 - b0 + 1, dtype=np.uint64)
        np.cumsum(x, out=total[1:])
        h = total[end[i:j] - b0] - total[start[i:j] - b0]
        h *= inverse[start[i:j] - b0]
        out[i:j] = mix(h + length[i:j].astype(np.uint64) * _STEP)
        i = j
    return out


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (runs may cross documents; see `inside_document`)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += hashes[j : j + n]
    return mix(h)


def inside_document(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, doc): whether the k words from each position lie in one document, and the document of each word."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(doc) - k + 1)
    return doc[:n] == doc[k - 1 : k - 1 + n], doc


def per_document(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many entries of a boolean array over the bytes (or words) are set, per document."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of the \\n-split lines, ordered by start."""
    breaks = np.flatnonzero(buf == 10)
    owner = np.searchsorted(offs, breaks, side="right") - 1
    start = np.concatenate([offs[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offs) - 1), owner])
    order = np.lexsort((doc, start))
    start, doc = start[order], doc[order]
    padded = np.append(breaks, len(buf) + 1)
    end = np.minimum(padded[np.searchsorted(breaks, start)], offs[doc + 1])
    return start, np.maximum(end, start), doc
