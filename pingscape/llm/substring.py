"""Removal of repeated word sequences by seed and extend.

A window is `min_words` consecutive words; a window that also starts earlier
(smaller id, or the same document at an earlier word) is removed, overlapping
windows as one maximal repeat.

Seeds: each window is assigned one anchor, the leftmost k-word run in it with the least
hash (winnowing).  The choice depends on the window's words alone, so equal windows meet at
equal anchors.  Consecutive windows share an anchor: an anchor with the words that its
windows reach to the left and right is an occurrence.

1. Count anchors.  Those that occur twice or more set a bit each in a table of fixed
   size; anchors whose bit is not set are unique and stop here.  (A bit set by chance costs
   work, not correctness; a full table would stop nothing and change no result.)
2. Extend: each repeated anchor is extended to the reach of its windows, and the
   extension hashed.  Of equal occurrences in a part of a task's rows only the first goes on;
   the others are repeats whatever lies elsewhere.
3. Equal extensions: all windows of every occurrence but the first are repeats.
   Different extensions of one anchor: their windows are compared one by one.
4. Repeats are gathered per document, merged, and cut out.

Equality is held by two 64-bit hashes (anchor and extension, or anchor and
window).  Per key a part of PART_BYTES sends one row, so one passage in a third of all rows
reaches a task as one row per part; an anchor in very many contexts meets their number in
salted pieces.  Null and empty texts have no words and stay
as they are; documents under `min_words` words lose nothing; very long texts are never cut.  An empty
table gives an empty one; other columns, whatever their names, are kept.  A null id comes before
all others.  Rows with equal id count as one document: none of them is earlier
than another at the same word; rows equal in id and text get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm import text as tx
from pingscape.llm.bits import bit_table, is_set, place
from pingscape.llm.components import with_totals
from pingscape.llm.storage import forget, free_name, saved

MIN_WORDS = 20
ANCHOR_WORDS = 8
#: Bits of the table of repeated anchors (a power of two): 16 MB, whatever the input's size.
TABLE_BITS = 1 << 27
#: Bits of the table of documents that lose words (8 MB).
DOCUMENT_BITS = 1 << 26
#: Text that is held with its anchors and windows at a time.
PART_BYTES = 8 << 20
_SPAN = "struct<s:int,e:int>"


def occurrences(buf: np.ndarray, offs: np.ndarray, min_words: int, k: int) -> dict[str, np.ndarray]:
    """Anchors of a slice's windows: anchor and extension hash, document, first window, number of windows; all window hashes."""
    start, end, first = tx.words(buf, offs)
    hashes = tx.span_hashes(buf, start, end)
    grams, windows = tx.gram_hashes(hashes, k), tx.gram_hashes(hashes, min_words)
    valid, doc = tx.inside_document(first, min_words)
    at = np.flatnonzero(valid)
    if not len(at):
        none = np.zeros(0, np.int64)
        return {"anchor": none.astype(np.uint64), "extension": none.astype(np.uint64), "doc": none, "start": none, "n": none, "at": none, "windows": windows}
    n = len(windows)
    chosen = np.arange(n) + sliding_window_view(grams, min_words - k + 1)[:n].argmin(axis=1)
    chosen = chosen[at]
    edge = np.flatnonzero(np.diff(chosen, prepend=-1))
    count = np.diff(np.append(edge, len(at)))
    begin, anchor = at[edge], chosen[edge]
    nth = (at - np.repeat(begin, count)).astype(np.uint64)
    reach = np.add.reduceat(tx.mix(windows[at] + nth), edge)
    reach = tx.mix(reach + (anchor - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    owner = doc[begin]
    return {"anchor": grams[anchor], "extension": reach, "doc": owner, "start": begin - first[owner], "n": count, "at": begin, "windows": windows}


def _merge(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [s, e) as disjoint intervals in order."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    head = np.concatenate([[True], s[1:] > e[:-1]])
    tail = np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)
    return s[head], e[tail]


def _anchor_counts(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """(anchor, n) with n at least 1 or 2 per batch: enough to tell repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [occurrences(buf, offs, min_words, k)["anchor"] for _, _, buf, offs in tx.slices(b.column("text"))]
            anchors, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])
        tx.give_back()

    return docs.select("text").mapInArrow(run, "anchor long, n byte")


def _repeated_table(counts: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the anchors that occur twice or more (bits / 8 bytes; holds no document)."""
    repeated = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    return bit_table(repeated.select(place(F.col("anchor"), bits).alias("place")), bits)


_CLAIMS = "text_key long, anchor long, extension long, start int, n int, windows array<long>, cut array<" + _SPAN + ">"


def _claims(docs: DataFrame, table, bits: int, min_words: int, k: int) -> DataFrame:
    """Rows of two kinds: the first occurrence in a batch of each (anchor, extension), and
    per document the intervals (`cut`) that an earlier row of its batch already repeats."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, _, _ in tx.slices(whole.column("text"), PART_BYTES):
                yield whole.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interval = pa.struct([("s", pa.int32()), ("e", pa.int32())])
        for b in parts(batches):
            ids = b.column("doc_id")
            # order of ids inside the part; equal ids share a rank, a null is the least
            order = ids.dictionary_encode()
            values = order.dictionary
            rank_of = np.empty(len(values) + 1, dtype=np.int64)
            rank_of[pa.compute.array_sort_indices(values).to_numpy()] = np.arange(len(values))
            rank_of[-1] = -1
            rank = rank_of[order.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)]
            got: dict[str, list[np.ndarray]] = {c: [] for c in ("anchor", "extension", "row", "start", "n", "at")}
            hashes: list[np.ndarray] = []
            base = 0
            for lo, _, buf, offs in tx.slices(b.column("text")):
                o = occurrences(buf, offs, min_words, k)
                keep = is_set(table.value, o["anchor"].view(np.int64) & (bits - 1))
                for c in ("anchor", "extension", "start", "n"):
                    got[c].append(o[c][keep])
                got["row"].append(o["doc"][keep] + lo)
                # only the windows of repeated anchors are held
                n = o["n"][keep]
                ends = np.cumsum(n)
                got["at"].append(base + ends - n)
                hashes.append(o["windows"][np.repeat(o["at"][keep] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)])
                base += len(hashes[-1])
            if not base:
                continue
            o = {c: np.concatenate(v) for c, v in got.items()}
            windows = np.concatenate(hashes)
            r = rank[o["row"]]
            by = np.lexsort((o["start"], r, o["extension"], o["anchor"]))
            same = (o["anchor"][by][1:] == o["anchor"][by][:-1]) & (o["extension"][by][1:] == o["extension"][by][:-1])
            group = np.concatenate([[0], np.cumsum(~same)])
            head = by[np.flatnonzero(np.concatenate([[True], ~same]))][group]
            later = (r[by] != r[head]) | (o["start"][by] != o["start"][head])
            first, repeat = by[~later], by[later]
            ends = np.cumsum(o["n"][first])
            flat = windows[np.repeat(o["at"][first] - (ends - o["n"][first]), o["n"][first]) + np.arange(int(ends[-1]))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
            key = b.column("text_key")
            nothing = pa.nulls(len(first), pa.list_(interval))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(o["row"][first])), key.take(pa.array(o["row"][first])), pa.array(o["anchor"][first].view(np.int64)), pa.array(o["extension"][first].view(np.int64)), pa.array(o["start"][first].astype(np.int32)), pa.array(o["n"][first].astype(np.int32)), lists, nothing],
                names=["doc_id", "text_key", "anchor", "extension", "start", "n", "windows", "cut"],
            )
            if len(repeat):
                # one number line for the batch, so that documents merge in one call
                width = int((o["start"][repeat] + o["n"][repeat]).max()) + min_words + 1
                s = o["row"][repeat] * width + o["start"][repeat]
                s, e = _merge(s, s + o["n"][repeat] + min_words - 1)
                row = s // width
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                spans = pa.StructArray.from_arrays([pa.array((s - row * width).astype(np.int32)), pa.array((e - row * width).astype(np.int32))], fields=list(interval))
                cut = pa.ListArray.from_arrays(pa.array(np.append(heads, len(s)).astype(np.int32)), spans)
                rows = pa.array(row[heads])
                empty = [pa.nulls(len(heads), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.take(rows), key.take(rows), *empty, cut], names=["doc_id", "text_key", "anchor", "extension", "start", "n", "windows", "cut"])
        tx.give_back()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_CLAIMS}")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, table_bits: int = TABLE_BITS) -> DataFrame:
    """(doc_id, text_key, cut): word intervals [s, e) to remove, one row per document that loses words; they may overlap."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = df.sparkSession.sparkContext.broadcast(_repeated_table(_anchor_counts(docs, min_words, anchor_words), table_bits))
    keyed = docs.where("text is not null").withColumn("text_key", F.xxhash64("text"))
    rows = saved(_claims(keyed, table, table_bits, min_words, anchor_words))
    table.unpersist()
    local = rows.where("cut is not null").select("doc_id", "text_key", "cut")
    claims = rows.where("cut is null").drop("cut")

    # one row per (anchor, extension): its first claim, and whether the anchor has other extensions
    spot = F.struct("doc_id", "start")
    firsts = saved(claims.groupBy("anchor", "extension").agg(F.min(spot).alias("spot"), F.count("*").alias("claims")))
    facts = with_totals(firsts, ["anchor"], "extension", kinds=(F.sum, F.lit(1))).where("claims > 1 or kinds > 1").select("anchor", "extension", "spot", (F.col("kinds") > 1).alias("varied"))
    known = claims.join(facts, ["anchor", "extension"]).withColumn("first", F.struct("doc_id", "start").eqNullSafe(F.col("spot")))
    known = saved(known.where("varied or not first").withColumn("windows", F.when(F.col("first"), F.col("windows"))).drop("spot", "extension"))

    # equal extensions: every claim but the first is cut whole
    whole = known.where("not first").select("doc_id", "text_key", F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + (min_words - 1)).alias("e"))).alias("cut"))

    # different extensions of one anchor: windows one by one, over the first claim of each extension
    single = known.where("first").select("doc_id", "text_key", "anchor", "start", F.posexplode("windows").alias("nth", "window"))
    single = saved(single.select("doc_id", "text_key", "anchor", "window", (F.col("start") + F.col("nth")).alias("start")))
    earliest = single.groupBy("anchor", "window").agg(F.min(spot).alias("spot"), F.count("*").alias("n")).where("n > 1").drop("n")
    partial = single.join(earliest, ["anchor", "window"]).where(F.struct("doc_id", "start") > F.col("spot"))
    partial = partial.select("doc_id", "text_key", F.array(F.struct(F.col("start").alias("s"), (F.col("start") + min_words).alias("e"))).alias("cut"))

    cut = local.unionByName(whole).unionByName(partial)
    return cut.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("cut")).alias("cut"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, str]:
    """`df` with one more struct column (n_words, n_removed, removed word intervals, kept words joined by
    one space, the text with the removed words cut out); returns the frame and the column's name."""
    names = list(df.columns)
    out = free_name(names, "repeats")
    cut = saved(repeats(df, id_col, text_col, **options))
    # only documents that lose words meet their cuts in a shuffle; a bit table tells which may
    spot = place(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_key"), DOCUMENT_BITS)
    table = df.sparkSession.sparkContext.broadcast(bit_table(cut.select(spot.alias("place")), DOCUMENT_BITS))
    key = F.xxhash64(F.col(f"`{text_col}`"))
    marked = df.withColumn(f"{out}_place", place(F.xxhash64(F.coalesce(F.col(f"`{id_col}`"), F.lit(-1)), key), DOCUMENT_BITS))
    nothing = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~is_set(table.value, b.column(f"{out}_place").to_numpy())))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.nulls(b.num_rows, nothing)], names=[*names, f"{out}_cut"])

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(is_set(table.value, b.column(f"{out}_place").to_numpy()))).select(names)

    cut = cut.select(F.col("doc_id").alias(f"{out}_id"), F.col("text_key").alias(f"{out}_key"), F.col("cut").alias(f"{out}_cut"))
    some = marked.mapInArrow(losing, df.schema)
    some = some.join(cut, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{out}_id")) & (key == F.col(f"{out}_key")), "left").drop(f"{out}_id", f"{out}_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interval = pa.struct([("s", pa.int32()), ("e", pa.int32())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                words, removed, spans, kept, left = [], [], [], [], []
                for text, cuts in zip(b.column(text_col), b.column(f"{out}_cut"), strict=True):
                    buf = text.as_buffer()
                    data = buf.to_pybytes() if buf is not None else b""
                    found = cuts.values
                    if found is None or not len(found):
                        n = data.split()
                        words.append(len(n))
                        removed.append(0)
                        spans.append([])
                        kept.append(b" ".join(n))
                        left.append(data if buf is not None else None)
                        continue
                    raw = np.frombuffer(data, np.uint8)
                    start, end, _ = tx.words(raw, np.array([0, len(raw)]))
                    s, e = _merge(found.field("s").to_numpy(), found.field("e").to_numpy())
                    stay = np.ones(len(start), dtype=bool)
                    for i, j in zip(s.tolist(), e.tolist(), strict=True):
                        stay[i:j] = False
                    # from a removed word to the next word that stays, nothing is kept
                    pieces, at_byte = [], 0
                    for i, j in zip(s.tolist(), e.tolist(), strict=True):
                        pieces.append(data[at_byte : start[i]])
                        at_byte = int(start[j]) if j < len(start) else len(data)
                    pieces.append(data[at_byte:])
                    words.append(len(start))
                    removed.append(int((~stay).sum()))
                    spans.append([{"s": i, "e": j} for i, j in zip(s.tolist(), e.tolist(), strict=True)])
                    kept.append(b" ".join([data[i:j] for i, j in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]))
                    left.append(b"".join(pieces).rstrip(b"\t\n\x0b\x0c\r "))
                fields = {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(interval)), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "text": pa.array(left, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.StructArray.from_arrays(list(fields.values()), names=list(fields))], names=[*names, out])

    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{out}` struct<n_words:long,n_removed:long,removed:array<{_SPAN}>,kept:string,text:string>"])
    both = marked.mapInArrow(lambda it: run(whole(it)), types).unionByName(some.mapInArrow(run, types))
    return both, out
