"""Sharding: a keyed shuffle of global row numbers that any row can compute for itself.

Rows are numbered 0 .. N-1 in the order of (id, size, checksum).  A balanced
Feistel network permutes the 2**(2h) >= N numbers; values of N and above walk the
cycle on until they fall below N, which makes it a permutation of the row numbers
alone.  With p the permuted number, the shard is p mod n_shards and the slot
p div n_shards: shard sizes differ by one row at most (law `rows`), slots have no
gaps, and `row_at` computes back which row lies in a slot.

The text never leaves the scan: only (id, size, checksum) are sorted.  The sorted
rows are saved with their place in their partition, so numbering needs one count
per partition and no second sort.  Null texts have no bytes; null ids come first;
rows that are equal in all three are interchangeable.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingscape.llm.storage import saved

ROUNDS = 6
MODULUS = (1 << 61) - 1


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(multiplier below 2**29, addend below 2**60) of each round, derived from the seed."""
    keys = []
    for i in range(ROUNDS):
        d = hashlib.sha256(f"{seed}/{i}".encode()).digest()
        keys.append((int.from_bytes(d[:8], "little") % (1 << 29) | 1, int.from_bytes(d[8:16], "little") % (1 << 60)))
    return keys


def half_bits(n: int) -> int:
    """Bits of each half of the network for n rows."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _f(r: np.ndarray, key: tuple[int, int], h: int) -> np.ndarray:
    return ((r * key[0] + key[1]) % MODULUS >> 20) & ((1 << h) - 1)


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """Apply a permutation of the whole domain until every value is below n."""
    y = step(x)
    out = np.flatnonzero(y >= n)
    while len(out):
        y[out] = step(y[out])
        out = out[y[out] >= n]
    return y


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Permuted row numbers (int64) of row numbers below n."""
    h, keys = half_bits(n), round_keys(seed)

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & ((1 << h) - 1)
        for k in keys:
            left, right = right, left ^ _f(right, k, h)
        return left << h | right

    return _walk(np.asarray(x, dtype=np.int64), n, step)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, n_shards: int, seed: int) -> np.ndarray:
    """The row number that lies in a slot: the inverse of the permutation."""
    h, keys = half_bits(n), round_keys(seed)

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & ((1 << h) - 1)
        for k in reversed(keys):
            left, right = right ^ _f(left, k, h), left
        return left << h | right

    return _walk(np.asarray(slot, dtype=np.int64) * n_shards + shard, n, step)


def numbered(df: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """`df` (narrow rows) with global row numbers in the given order, and the number of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the number of partitions, not by the data
    offsets = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_place"))
    return rows.drop("_part", "_place", "_before"), int(total)


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], names=[*b.schema.names, "shard", "slot"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id {id_type}, size long, text_crc32 long, row_number long, shard int, slot long")
