"""Exact top-k search by inner product on a bit-sliced index.

Components are quantised to integers, floor(scale * x) in double precision.  A block of up
to BLOCK_ROWS vectors is held as bitmaps: bitmap (d, b) has the rows whose component d,
less the block's least one, has bit b set.

A query is answered per block by bitmap arithmetic alone:

1. The components go in chunks of CHUNK.  The sums of every subset of a chunk are
   added once per block, as sliced numbers (one bitmap per bit, a full adder per slice).
2. Bit b of the query's components picks one subset sum of each chunk; a tree of sliced
   additions gives the block's sum for that bit, and shifted sums of all bits give the scores,
   as slices in two's complement.
3. Selection goes from the most significant slice down and keeps the rows that are surely among
   the best and those still undecided.  What is undecided after the last slice has equal
   scores: the boundary, resolved exactly by the smaller id (rows of a block are in id order).
4. Scores of the selected rows are read back from the slices.

Rows are dealt to groups by a hash of id and vector; a group is some blocks (at most about
GROUP_BYTES) in one task.  Queries go to every group and stream past its blocks, so a
task holds a group's index, one batch of queries and k results each.  The best k of
the groups' best k are the result, exactly.

Defined results: vectors that are null or hold null or non-finite components, rows without id, and
vectors whose quantised components pass sqrt(2**61 / dimension), for which a score might not fit a
long, take no part.  Vectors are compared with those of equal dimension; empty ones score 0.  Ties go
to the smaller id.  Rows that share an id are candidates each, but none to a query of that id; equal rows
(id and vector) are one query, and only the first k of them can be in a result.  An empty table, or
one without queries, gives an empty result.  Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024.0
K = 10
BLOCK_ROWS = 8192
CHUNK = 4
MAX_GROUPS = 256
GROUP_BYTES = 64 << 20
QUERY_BATCH = 512


def add(a: np.ndarray, b: np.ndarray, width: int | None = None) -> np.ndarray:
    """Sum of two sliced numbers (slices on axis 0, least first), in `width` slices, modulo 2**width."""
    shape = np.broadcast_shapes(a.shape[1:], b.shape[1:])
    width = max(len(a), len(b)) + 1 if width is None else width
    out = np.empty((width, *shape), dtype=np.uint64)
    carry = np.zeros(shape, dtype=np.uint64)
    for i in range(width):
        if i < len(a) and i < len(b):
            half = a[i] ^ b[i]
            np.bitwise_xor(half, carry, out=out[i])
            carry &= half
            carry |= a[i] & b[i]
        elif i < len(a) or i < len(b):
            one = a[i] if i < len(a) else b[i]
            np.bitwise_xor(one, carry, out=out[i])
            carry &= one
        else:
            out[i] = carry
            carry = np.zeros(shape, dtype=np.uint64)
    return out


def _sum(parts: np.ndarray) -> np.ndarray:
    """Sum over axis 1 of sliced numbers, as a tree."""
    while parts.shape[1] > 1:
        half = parts.shape[1] // 2
        total = add(parts[:, :half], parts[:, half : 2 * half])
        if parts.shape[1] % 2:
            rest = np.zeros((len(total), 1, *parts.shape[2:]), dtype=np.uint64)
            rest[: len(parts)] = parts[:, -1:]
            total = np.concatenate([total, rest], axis=1)
        parts = total
    return parts[:, 0]


def sliced(values: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (width, ..., words) of the bits of non-negative integers; rows on the last axis."""
    rows = values.shape[-1]
    bits = np.zeros((width, *values.shape[:-1], -(-rows // 64) * 64), dtype=np.uint8)
    for i in range(width):
        bits[i, ..., :rows] = (values >> i) & 1
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Block:
    """Bit-sliced index of vectors (rows x dimension, integers) in id order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows, self.dim = ids, len(ids), vectors.shape[1]
        self.low = vectors.min(axis=0)
        chunks = -(-self.dim // CHUNK)
        raised = np.zeros((chunks * CHUNK, self.rows), dtype=np.int64)
        raised[: self.dim] = (vectors - self.low).T
        width = max(1, int(raised.max(initial=0)).bit_length())
        self.slices = sliced(raised, width).reshape(width, chunks, CHUNK, -(-self.rows // 64))
        self.sums = raised.sum(axis=0)
        self.every = sliced(np.ones((1, self.rows), dtype=np.int64), 1)[0, 0]

    def subset_sums(self) -> np.ndarray:
        """(slices, chunks, 2**CHUNK, words): sliced sums of every subset of each chunk's components."""
        width, chunks, _, words = self.slices.shape
        out = np.zeros((width + CHUNK.bit_length() - 1, chunks, 1 << CHUNK, words), dtype=np.uint64)
        for d in range(CHUNK):
            # all subsets whose highest member is d
            out[:width, :, 1 << d] = self.slices[:, :, d]
            if d:
                out[:, :, (1 << d) + 1 : 2 << d] = add(out[:, :, 1 : 1 << d], self.slices[:, :, d, None], len(out))
        return out

    def query_bits(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """(bits x chunks) subset numbers of query + 2**(bits - 1), and the number of bits."""
        bits = max(int(query.max(initial=0)), -int(query.min(initial=0)) - 1, 1).bit_length() + 1
        raised = np.zeros(self.slices.shape[1] * CHUNK, dtype=np.int64)
        raised[: self.dim] = query + (1 << (bits - 1))
        each = (raised[None, :] >> np.arange(bits)[:, None]) & 1
        return each.reshape(bits, -1, CHUNK) @ (1 << np.arange(CHUNK)), bits

    def scores(self, query: np.ndarray, subsets: np.ndarray) -> np.ndarray:
        """Slices of score - sum(query * low) in two's complement."""
        picked, bits = self.query_bits(query)
        parts = _sum(subsets[:, np.arange(subsets.shape[1])[:, None], picked.T])  # slices, bits, words
        step = 1
        while parts.shape[1] > 1:
            # neighbouring bits, then pairs, ...: the upper one counts `step` slices more
            even, odd = parts[:, ::2], parts[:, 1::2]
            wide = np.zeros((len(odd) + step, *even.shape[1:]), dtype=np.uint64)
            wide[step:, : odd.shape[1]] = odd
            parts, step = add(wide, even), 2 * step
        width = min(64, len(parts) + 2)
        # the raised query counted every row's sum 2**(bits - 1) times too often
        excess = (-(self.sums << (bits - 1))).view(np.uint64)
        return add(parts[:, 0], sliced(excess[None, :], width)[:, 0], width)

    def top(self, slices: np.ndarray, k: int, not_id: int) -> np.ndarray:
        """Rows with the k highest scores, not those with the id `not_id`; ties to the smaller id."""
        lo, hi = np.searchsorted(self.ids, [not_id, not_id + 1]) if not_id < np.iinfo(np.int64).max else (0, 0)
        open_ = self.every.copy()
        for row in range(lo, hi):
            open_[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure, n_sure = np.zeros_like(open_), 0
        for i in range(len(slices) - 1, -1, -1):
            # the top slice is the sign: rows without it are higher
            higher = open_ & (~slices[i] if i == len(slices) - 1 else slices[i])
            n = n_sure + int(np.bitwise_count(higher).sum())
            if n > k:
                open_ = higher
            else:
                sure, n_sure = sure | higher, n
                open_ = open_ & ~higher
                if n == k:
                    break
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        return np.concatenate([rows(sure), rows(open_)[: k - n_sure]]) if n_sure < k else rows(sure)

    def read(self, slices: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of rows, from their bits."""
        bits = ((slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
        weight = np.int64(1) << np.arange(len(slices), dtype=np.int64)
        weight[-1] = -weight[-1]
        return weight @ bits + int((query * self.low).sum())

    def best(self, query: np.ndarray, subsets: np.ndarray, k: int, not_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of the block."""
        if not self.dim:
            rows = np.flatnonzero(self.ids != not_id)[:k]
            return self.ids[rows], np.zeros(len(rows), np.int64)
        slices = self.scores(query, subsets)
        rows = self.top(slices, k, not_id)
        return self.ids[rows], self.read(slices, rows, query)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, dim, v): little-endian 32-bit integers floor(scale * x) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            n = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            flat = lists.flatten().cast(pa.float64())
            x = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum(n)
            bound = np.repeat(np.minimum(np.floor(np.sqrt(2.0**61 / np.maximum(n, 1))), 2**31 - 1), n)
            wrong = np.concatenate([[0], np.cumsum(~(np.abs(x) <= bound))])  # not a number counts as well
            good = wrong[ends] == wrong[ends - n]
            data = np.where(np.abs(x) <= bound, x, 0).astype("<i4")
            v = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), v], names=["id", "dim", "v"]).filter(pa.array(good))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).where("id is not null and vector is not null")
    return rows.mapInArrow(run, "id long, dim int, v binary")


class _Group:
    """The blocks of one group, and the queries that stream past them."""

    def __init__(self, key: tuple[int, int], k: int) -> None:
        self.key, self.k, self.blocks = key, k, []
        self.ids, self.vectors, self.last, self.copies = [], [], None, 0

    def row(self, i: int, v: bytes) -> None:
        # equal rows follow each other; of more than k of them none can be in a result
        self.copies = self.copies + 1 if self.last == (i, v) else 1
        self.last = (i, v)
        if self.copies <= self.k:
            self.ids.append(i)
            self.vectors.append(v)
            if len(self.ids) == BLOCK_ROWS:
                self.close()

    def close(self) -> None:
        if self.ids:
            vectors = np.frombuffer(b"".join(self.vectors), "<i4").reshape(len(self.ids), self.key[1])
            self.blocks.append(Block(np.array(self.ids, dtype=np.int64), vectors.astype(np.int64)))
            self.ids, self.vectors = [], []

    def answer(self, queries: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """The k best rows of the group for each (id, number, vector)."""
        found: list[list] = [[] for _ in queries]
        numbers = [np.frombuffer(v, "<i4").astype(np.int64) for _, _, v in queries]
        for block in self.blocks:
            subsets = block.subset_sums() if block.dim else None
            for (i, _, _), query, out in zip(queries, numbers, found, strict=True):
                out.append(block.best(query, subsets, self.k, i))
        columns: list[list] = [[], [], [], []]
        for (i, number, _), parts in zip(queries, found, strict=True):
            ids, scores = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in (0, 1))
            order = np.lexsort((ids, -scores))[: self.k]
            for column, values in zip(columns, ([i] * len(order), [number] * len(order), ids[order], scores[order]), strict=True):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_number", "vec_id", "score"])


def top_k(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which `is_query` (a
    condition on column `id`) holds, among all rows but its own."""
    rows = quantised(df, id_col, vec_col, scale)
    n_rows, n_bytes = df.agg(F.count("*"), F.sum(4 * F.greatest(F.size(vec_col), F.lit(1)).cast("long"))).first()
    groups = max(1, min(-(-n_rows // BLOCK_ROWS), MAX_GROUPS), -(-(n_bytes or 0) // GROUP_BYTES))
    number = F.xxhash64("v")
    placed = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group"), "dim", F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("number"), "v")
    asked = rows.where(is_query).select("id", "dim", "v", number.alias("number")).distinct()
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", F.lit(True).alias("asks"), "id", "number", "v")
    # rows of a group before its queries
    met = placed.unionByName(copies).repartition(groups, "group").sortWithinPartitions("group", "dim", "asks", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting = None, []
        for b in batches:
            for g, dim, asks, i, query, v in zip(*(b.column(c).to_pylist() for c in ("group", "dim", "asks", "id", "number", "v")), strict=True):
                if group is None or group.key != (g, dim):
                    if waiting:
                        yield group.answer(waiting)
                        waiting = []
                    group = _Group((g, dim), k)
                if not asks:
                    group.row(i, v)
                    continue
                group.close()
                waiting.append((i, query, v))
                if len(waiting) == QUERY_BATCH:
                    yield group.answer(waiting)
                    waiting = []
        if waiting:
            yield group.answer(waiting)

    found = met.mapInArrow(run, "query_id long, query_number long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
