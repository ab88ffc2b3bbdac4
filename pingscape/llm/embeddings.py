"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

1. A bounded sample is projected on its principal directions and rotated so that the signs
   lose least (iterative quantisation): balanced binary codes.  Signs are taken about the
   origin, so that two vectors at a given angle agree in a bit with a known chance wherever
   the data lie, also where most of them form one cluster.  More than one rotation
   (each from another start) gives as many bits as the tables need.
2. The code is cut into tables of `bits` bits; two vectors are candidates where any
   table agrees.  `bits` follows the logarithm of the rows per label, so buckets keep
   their size as the input grows; the number of tables follows from the angle of the
   threshold and the recall aimed at.
3. Candidates are compared with the original vectors in double precision, as blocks
   of a bucket: a block gives each vector its number of links and the least id it
   is connected to in the block, never pairs.  A pair that agrees in several tables
   counts in the first.

Equal vectors of a label are one class with one representative, and count by their
number.  Buckets over BLOCK_ROWS rows are cut into blocks, and every pair of
blocks is a group of its own.  Vectors that are null, zero, without label, or that
hold null or non-finite components link with nothing; vectors of different length
are never compared.  Rows without id link with nothing and have no component; rows that
repeat an id share its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm.components import connected, leaders, salted
from pingscape.llm.storage import saved

THRESHOLD = 0.98
SAMPLE_ROWS = 8192
BLOCK_ROWS = 1024
TARGET_RECALL = 0.995


def fit_rotations(sample: np.ndarray, n_bits: int, seed: int = 7, rounds: int = 40) -> np.ndarray:
    """Projection with at least n_bits columns: principal directions times learned rotations."""
    d = sample.shape[1]
    _, directions = np.linalg.eigh(sample.T @ sample + 1e-12 * np.eye(d))
    v = sample @ directions
    out: list[np.ndarray] = []
    rng = np.random.default_rng(seed)
    while sum(p.shape[1] for p in out) < n_bits:
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds if len(sample) else 0):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        out.append(directions @ r)
    return np.hstack(out)


def table_layout(rows_per_label: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a table, number of tables)."""
    bits = min(30, max(8, round(math.log2(max(2, rows_per_label))) - 2))
    agree = (1.0 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - agree)))


def _vectors(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Per row the length of a usable vector (0: not usable); per length its rows and unit vectors."""
    sizes = np.zeros(len(column), dtype=np.int64)
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = pa.compute.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
        with np.errstate(invalid="ignore", over="ignore"):
            scale = np.abs(x).max(axis=1)
            good = np.isfinite(x).all(axis=1) & (scale > 0)
        rows, x = rows[good], x[good] / scale[good][:, None]  # no overflow or underflow in the norm
        sizes[rows] = d
        by[d] = (rows, x / np.linalg.norm(x, axis=1)[:, None])
    return sizes, by


def _describe(df: DataFrame) -> DataFrame:
    """(vec_id, label, dim, k1, k2) of the usable vectors, with the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, by = _vectors(b.column("embedding"))
            hashes = np.zeros((len(sizes), 2), dtype=np.int64)
            for rows, x in by.values():
                raw = np.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x + 0.0], dtype="S16") if len(rows) else np.zeros(0, "S16")
                hashes[rows] = np.frombuffer(raw.tobytes(), dtype=np.int64).reshape(-1, 2)
            good = pa.array(sizes > 0)
            full = pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=[*b.schema.names, "dim", "k1", "k2"])
            yield full.filter(good)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, embedding {types['embedding']}, dim int, k1 long, k2 long")


def _chunks(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Table values (rows x tables) of sign bits (rows x at least bits * tables)."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    return code[:, : bits * tables].reshape(len(code), tables, bits) @ weights


def _bucketed(reps: DataFrame, models: dict, bits: int, tables: int) -> DataFrame:
    """A row per representative and table: bucket value, all table values, and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, by = _vectors(b.column("embedding"))
            values = np.zeros((b.num_rows, tables), dtype=np.int32)
            for d, (rows, x) in by.items():
                projection = models.value[d] if d in models.value else fit_rotations(np.zeros((0, d)), bits * tables)
                values[rows] = _chunks(x @ projection >= 0, bits, tables)
            chunks = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, chunks], names=[*b.schema.names, "chunks"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    coded = reps.mapInArrow(run, f"{types}, chunks array<int>")
    return coded.select("*", F.posexplode("chunks").alias("tab", "bucket"))


def _block_links(rows: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(id, links, least connected id) of the linked vectors of one group of one or two blocks."""
    tab, both = rows[0]["tab"], rows[0]["left"] != rows[0]["right"]
    ids = np.array([r["vec_id"] for r in rows])
    weight = np.array([r["size"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if both:  # pairs inside a block belong to the group of that block with itself
        block = np.array([r["block"] for r in rows])
        near &= block[:, None] != block[None, :]
    if not near.any():
        return []
    if tab:
        c = np.array([r["chunks"][:tab] for r in rows])
        for t in range(tab):  # agreed in an earlier table: counted there
            near &= c[:, t][:, None] != c[:, t][None, :]
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return []
    near = near[np.ix_(linked, linked)]
    ids, weight = ids[linked], weight[linked]
    least = ids.copy()
    while True:
        step = np.minimum(least, np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (step == least).all():
            break
        least = step
    return list(zip(ids.tolist(), (near @ weight).tolist(), least.tolist(), strict=True))


def _links(groups: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, links, least) per group, streamed: one group is held at a time."""
    key = ["label", "dim", "tab", "bucket", "left", "right"]
    dealt = groups.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def table(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["vec_id", "links", "least"])

        for b in batches:
            found: list[tuple[int, int, int]] = []
            for row in b.to_pylist():
                k = tuple(row[c] for c in key)
                if k != now:
                    if len(held) > 1:
                        found += _block_links(held, threshold)
                    now, held = k, []
                held.append(row)
            if found:
                yield table(found)
        if len(held) > 1:
            yield table(_block_links(held, threshold))

    return dealt.mapInArrow(run, "vec_id long, links long, least long")


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    recall: float = TARGET_RECALL,
    sample_rows: int = SAMPLE_ROWS,
    layout: tuple[int, int] | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links hold within a label at cosine >= threshold.

    `layout` (bits of a table, number of tables) follows the rows per label unless it is given.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    usable = _describe(rows.where("vec_id is not null and label is not null and embedding is not null"))
    key = ["label", "dim", "k1", "k2"]
    narrow = saved(usable.select("vec_id", *key))
    counts = narrow.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = layout or table_layout(counts, threshold, recall)

    sample = usable.select("dim", "embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample_rows).toArrow()
    models = {}
    for d in set(sample["dim"].to_pylist()):
        part = sample.filter(pa.compute.equal(sample["dim"], d))["embedding"].combine_chunks()
        models[d] = fit_rotations(_vectors(part)[1][d][1], bits * tables)

    led = saved(leaders(narrow, key, "vec_id"))
    sizes = led.select(*key, F.col("leader").alias("vec_id"), "size").distinct()
    reps = usable.join(sizes, ["vec_id", *key]).dropDuplicates(["vec_id", *key]).select("vec_id", "label", "dim", "size", "embedding")
    cells = saved(_bucketed(reps, spark.sparkContext.broadcast(models), bits, tables))

    # only buckets over a block's size are cut; each pair of their blocks is a group
    place = ["label", "dim", "tab", "bucket"]
    big = cells.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).drop("n")
    cells = cells.join(big, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    groups = cells.select("*", other).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")

    found = saved(_links(groups, threshold))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comps = connected(found.where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    per_class = led.join(links.withColumnRenamed("vec_id", "leader"), "leader", "left").join(comps.withColumnsRenamed({"id": "leader"}), "leader", "left")
    per_class = per_class.select(*key, "salt", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "leader").alias("component_id"))
    judged = salted(narrow, "vec_id").join(per_class, [*key, "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.select("vec_id", "label", "embedding")
    rest = _unusable(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unusable(df: DataFrame) -> DataFrame:
    """The rows that `_describe` and the null tests leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, _ = _vectors(b.column("embedding"))
            out = (sizes == 0) | ~b.column("vec_id").is_valid().to_numpy(zero_copy_only=False) | ~b.column("label").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(out))], names=["vec_id"])

    return df.mapInArrow(run, "vec_id long")
