"""Running numbers and digests along ordered groups, however long one group is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pingscape.llm.storage import saved


def running(df: DataFrame, key: str, order: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """`df` with `pos`, each row's number (from 0) among the rows of its key in the given order, and with every
    (long) column in `xors` replaced by the running exclusive or up to the row.

    Rows are range-partitioned by key and order, so a group may span many tasks: each task
    numbers its own part, and one row per partition (its last key's totals) goes to the driver
    and back as an offset.  `key` is a long without nulls.
    """
    names = df.columns
    ordered = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    extra = [StructField("_part", IntegerType()), StructField("pos", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, held = None, 0, [np.int64(0)] * len(xors)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(key).to_numpy()
            head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
            goes_on = last is not None and k[0] == last
            pos = np.arange(n) - head[group]
            pos[group == 0] += count if goes_on else 0
            columns = {c: b.column(c) for c in names}
            for i, c in enumerate(xors):
                total = np.bitwise_xor.accumulate(b.column(c).to_numpy())
                before = np.append(0, total)[head]
                if goes_on:
                    before[0] ^= held[i]
                out = total ^ before[group]
                held[i] = out[-1]
                columns[c] = pa.array(out)
            last, count = k[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(n, part, np.int32)), pa.array(pos)], names=[*names, "_part", "pos"])

    local = saved(ordered.mapInArrow(run, StructType([*df.schema.fields, *extra])))
    ends = local.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key, "pos", *xors)).alias("last")).collect()
    rows, carry = [], None
    for e in sorted(ends, key=lambda r: r["_part"]):
        zero = (0,) * (1 + len(xors))
        offset = carry[1] if carry and carry[0] == e["first"] else zero
        if offset != zero:
            rows.append((e["_part"], e["first"], *offset))
        now = (e["last"]["pos"] + 1, *(e["last"][c] for c in xors))
        if e["last"][key] == e["first"]:
            now = (now[0] + offset[0], *(a ^ b for a, b in zip(now[1:], offset[1:], strict=True)))
        carry = (e["last"][key], now)
    if not rows:
        return local.drop("_part")
    # one row per partition at most
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["_part int", f"`{key}` long", "_pos long", *[f"_x{i} long" for i in range(len(xors))]]))
    both = local.join(F.broadcast(offsets), ["_part", key], "left")
    whole = {c: F.coalesce(F.col(c).bitwiseXOR(F.col(f"_x{i}")), F.col(c)).alias(c) for i, c in enumerate(xors)}
    return both.select(*[whole.get(c, F.col(f"`{c}`")) for c in names], (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"))
