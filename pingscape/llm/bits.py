"""Tables of bits of a fixed size, to drop rows before a shuffle that no partner can have.

A table holds one bit per place; values are hashed to places.  Its size is a
parameter and never grows with the data; it holds no id and no text.  A bit that two
values share costs work, not correctness: whatever passes is joined exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET = 32768  # bits per row of bitmap_construct_agg


def place(value: Column, bits: int) -> Column:
    """Place of a 64-bit hash, 0 .. bits - 1."""
    return F.pmod(value, F.lit(bits))


def bit_table(places: DataFrame, bits: int) -> np.ndarray:
    """Table (bits / 8 bytes) with the bits of column `place` set; bits of one place combine map-side."""
    one = F.col("place") + 1
    rows = places.select(F.bitmap_bucket_number(one).alias("bucket"), F.bitmap_bit_position(one).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, part in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        at = (bucket - 1) * _BUCKET // 8
        table[at : at + len(part)] = np.frombuffer(part, np.uint8)[: len(table) - at]
    return table


def is_set(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
