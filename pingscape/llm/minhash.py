"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with how often it
occurred before.  Two documents are linked when

    aligned / (n_a + n_b - aligned) >= 0.8

where `aligned` is the longest run of labelled shingles common to both in the same
order: Jaccard similarity that also respects order, so moved text counts as
edited text.

1. Documents with equal words are one class, represented by the least id.
2. Order MinHash: each of `N_SKETCHES` hash functions takes the `SKETCH_SIZE` least labelled
   shingles of a document and keeps them in text order; representatives that agree
   in a sketch share a bucket.
3. In a bucket every member is verified against one leader (the member that
   shares most buckets: the hub of a group of edited copies), which is linear in
   the bucket.  A leader's shingles go to the pieces of its members once, not with every pair.
4. Buckets that then still hold several components are finished exactly, blocks of members
   against blocks of members.  First by parity bitmaps of one bit in 4 to 8 a shingle: two
   documents differ in at least as many shingles as their bitmaps differ in bits, so pairs
   whose bitmaps differ in more bits than a link allows are dropped, which loses none that
   is similar.  Only members left in some pair meet again with their shingles: one matrix
   product counts the common shingles of all pairs of two blocks, and pairs with enough of them
   are aligned unless links found meanwhile joined them.  Every pair that shares a sketch is
   thus verified, shown to be too different, or already in one component.
5. Verification aligns in a band: a shingle pair too far off the diagonal to be part of
   a sufficient alignment is dropped, which loses none that is sufficient.  Only documents
   of candidate pairs leave the scan, as shingle hashes (a bit table of fixed size tells which).

Shorter texts have one shingle of all their words.  Documents without words (null
or empty texts) and rows without id link with nothing and are kept.  Rows that
share an id are one document.  Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingscape.llm import text as tx
from pingscape.llm.bits import bit_table, is_set, place
from pingscape.llm.components import connected, leaders, salted, with_totals
from pingscape.llm.storage import forget, saved

SHINGLE_WORDS = 5
SIMILARITY = 0.8
N_SKETCHES = 16
SKETCH_SIZE = 2
#: A block of bitmaps has about so many members, or shingles where its documents are long.
MARKED_MEMBERS = 1024
MARKED_SHINGLES = 1 << 20
#: The same of a block of whole shingle sequences.
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 18
#: Pairs, and words of bitmaps, that are compared in one step.
STEP_PAIRS = 1 << 16
STEP_WORDS = 1 << 20
#: Shingles of one step of the product that counts common ones.
STEP_SHINGLES = 4096
#: Bits of the table of documents in candidate pairs (8 MB, whatever the input's size).
TABLE_BITS = 1 << 26


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = tx.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s[:n], s[n:] | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, labelled hash, begin, content): shingles of all documents in text order, where each
    document begins, and two hashes of each document's words."""
    start, end, first = tx.words(buf, offs)
    hashes = tx.span_hashes(buf, start, end)
    count = np.diff(first)
    grams = tx.gram_hashes(hashes, k)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begin[-1], dtype=np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    where = np.arange(begin[-1]) - begin[doc] + first[doc]
    full = count[doc] >= k
    out[full] = grams[where[full]]
    for d in np.flatnonzero((count > 0) & (count < k)).tolist():
        out[begin[d]] = tx.gram_hashes(hashes[first[d] : first[d + 1]], int(count[d]))[0] + np.uint64(count[d])
    # occurrence number of each shingle in its document
    keyed = tx.mix(out + tx.mix(doc.astype(np.uint64)))
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    seen = np.empty(len(out), dtype=np.uint64)
    seen[order] = (np.arange(len(out)) - np.repeat(head, np.diff(np.append(head, len(out))))).astype(np.uint64)
    labelled = tx.mix(out ^ (seen * np.uint64(0xD6E8FEB86659FD93)))
    words = tx.mix(hashes + (np.arange(len(hashes)) - np.repeat(first[:-1], count)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)]) for h in (words, tx.mix(words ^ np.uint64(0xA5A5A5A55A5A5A5A)))]
    content = np.stack([t[first[1:]] - t[first[:-1]] for t in totals], axis=1)
    return out, labelled, begin, content


def order_sketches(plain: np.ndarray, labelled: np.ndarray, begin: np.ndarray, n_sketches: int = N_SKETCHES, size: int = SKETCH_SIZE) -> np.ndarray:
    """(documents x n_sketches) keys: the `size` least labelled shingles per hash function, in text order."""
    n = np.diff(begin)
    some = np.flatnonzero(n > 0)
    out = np.zeros((len(n), n_sketches), dtype=np.uint64)
    if not len(some):
        return out
    heads, own = begin[:-1][some], np.repeat(np.arange(len(some)), n[some])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t, (a, b) in enumerate(zip(*_seeds(n_sketches), strict=True)):
        h = (labelled ^ a) * b
        chosen = np.full((len(some), size), np.iinfo(np.int64).max)
        for i in range(size):
            least = np.minimum.reduceat(h, heads)
            at = np.flatnonzero((h == least[own]) & (h != top))
            docs, first = np.unique(own[at], return_index=True)
            chosen[docs, i] = at[first]
            h[at[first]] = top
        chosen.sort(axis=1)
        key = np.full(len(some), t, dtype=np.uint64)
        for i in range(size):
            there = chosen[:, i] < len(plain)
            key = tx.mix(key * np.uint64(31) + np.where(there, plain[np.minimum(chosen[:, i], len(plain) - 1)], np.uint64(i)))
        out[some, t] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Longest common sequence of two sequences of labelled shingles (each value once), if at least `need`; else less than `need`."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return len(i)
    order = np.argsort(i)
    i, j = i[order], j[order]
    # the band: what can lie before and after the pair must leave room for `need`
    room = np.minimum(i, j) + 1 + np.minimum(len(a) - 1 - i, len(b) - 1 - j)
    j = j[room >= need]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for v in j.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two documents (labelled shingles in order) are linked."""
    total = len(a) + len(b)
    need = int(np.ceil(similarity / (1 + similarity) * total - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    m = aligned(a, b, need)
    return m >= similarity * (total - m) - 1e-9


def _sketches(df: DataFrame) -> DataFrame:
    """(doc_id, n, c1, c2, keys) of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tx.slices(b.column("text")):
                plain, labelled, begin, content = shingles(buf, offs)
                keys = order_sketches(plain, labelled, begin).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                n = np.diff(begin)
                content = np.ascontiguousarray(content).view(np.int64)
                out = pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(np.ascontiguousarray(content[:, 0])), pa.array(np.ascontiguousarray(content[:, 1])), lists], names=["doc_id", "n", "c1", "c2", "keys"])
                yield out.filter(pa.array(n > 0))
        tx.give_back()

    return df.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, keys array<long>")


def _sequences(df: DataFrame, table, form) -> DataFrame:
    """(doc_id, seq): labelled shingles in text order, as the bytes of `form`, of the documents whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            b = whole.filter(pa.array(is_set(table.value, whole.column("place").to_numpy())))
            for lo, hi, buf, offs in tx.slices(b.column("text")):
                _, labelled, begin, _ = shingles(buf, offs)
                seq = [form(labelled[i:j]).tobytes() for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(seq, pa.binary())], names=["doc_id", "seq"])
        tx.give_back()

    return df.mapInArrow(run, "doc_id long, seq binary")


def _wanted(ids: DataFrame, docs: DataFrame, form=np.asarray) -> DataFrame:
    """(doc_id, seq) of the documents in column `id` (and of some others, where bits meet); `seq` is the whole sequence unless `form` makes something of it."""
    spot = lambda c: place(F.xxhash64(c), TABLE_BITS).alias("place")
    table = bit_table(ids.select(spot("id")), TABLE_BITS)
    return _sequences(docs.select("doc_id", "text", spot("doc_id")), docs.sparkSession.sparkContext.broadcast(table), form)


def _long_enough(similarity: float):
    return F.least("n", "other_n") >= F.lit(similarity) * F.greatest("n", "other_n")


def _led_links(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The links among pairs (id, lead); the members of a leader are verified in SALTS pieces, to each of which its sequence goes once."""
    pairs = salted(pairs, "id")
    asked = pairs.select("lead", "salt", "id", F.lit(True).alias("member"))
    asked = saved(asked.unionByName(pairs.select("lead", "salt", F.col("lead").alias("id"), F.lit(False).alias("member")).distinct()))
    met = asked.join(_wanted(asked, docs).withColumnRenamed("doc_id", "id").hint("merge"), "id")
    met = met.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, led = None, None
        for x in batches:
            hit = []
            for lead, salt, member, seq in zip(*(x.column(c).to_pylist() for c in ("lead", "salt", "member")), x.column("seq"), strict=True):
                shingled = np.frombuffer(seq.as_buffer(), np.uint64)
                if not member:
                    key, led = (lead, salt), shingled.copy()
                hit.append(member and key == (lead, salt) and similar(led, shingled, similarity))
            yield x.select(["id", "lead"]).filter(pa.array(hit, pa.bool_()))

    return met.select("lead", "salt", "member", "id", "seq").mapInArrow(run, "id long, lead long")


def parity_marks(seq: np.ndarray) -> np.ndarray:
    """Bitmap (bytes) of which bits an odd number of shingles falls on; 4 to 8 bits a shingle, a power of two."""
    bits = max(64, 1 << (4 * len(seq) - 1).bit_length())
    return np.packbits(np.bincount((seq & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def _folded(marks: np.ndarray) -> np.ndarray:
    """The same bitmaps with half as many bits (the upper half of the places falls on the lower)."""
    half = marks.shape[1] // 2
    return marks[:, :half] ^ marks[:, half:]


def close_members(left: list[tuple], right: list[tuple] | None, key: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(places in left, places in right) of the members of two blocks of a bucket, or of one block (`right` is None), that
    belong to a pair that may be linked: components differ, bitmaps differ in no more bits than a link allows, and
    no earlier sketch is shared (that bucket has the pair).  Members are (id, component, keys, n, marks)."""
    other = left if right is None else right
    hit, other_hit = np.zeros(len(left), dtype=bool), np.zeros(len(other), dtype=bool)
    if left and other and len({m[1] for m in (*left, *other)}) > 1:
        n, other_n = (np.array([m[3] for m in side], dtype=np.int64) for side in (left, other))
        comp, other_comp = (np.array([m[1] for m in side], dtype=np.int64) for side in (left, other))
        keys, other_keys = np.stack([m[2] for m in left]), np.stack([m[2] for m in other])
        sketch = int(np.argmax(keys[0] == key))
        allowed = (1 - similarity) / (1 + similarity)
        by_size: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for side in (left, other):
            size = np.array([len(m[4]) for m in side])
            by_size.append({s: (at := np.flatnonzero(size == s), np.stack([side[i][4] for i in at]).view(np.uint64)) for s in np.unique(size).tolist()})
        for s, (at, marks) in by_size[0].items():
            # similar documents have sizes that differ by a factor of two at most
            for t, (other_at, other_marks) in by_size[1].items():
                if t not in (s // 2, s, 2 * s):
                    continue
                a, b = (_folded(marks) if t < s else marks), (_folded(other_marks) if t > s else other_marks)
                step = max(1, min(STEP_PAIRS // len(b), STEP_WORDS // b.size))
                for lo in range(0, len(a), step):
                    differ = np.zeros((len(a[lo : lo + step]), len(b)), dtype=np.int64)
                    for w in range(0, b.shape[1], 16):
                        differ += np.bitwise_count(a[lo : lo + step, None, w : w + 16] ^ b[None, :, w : w + 16]).sum(axis=2, dtype=np.int64)
                    i, j = np.nonzero(differ <= np.floor(allowed * np.add.outer(n[at[lo : lo + step]], other_n[other_at]) + 1e-9))
                    i, j = at[lo + i], other_at[j]
                    good = (comp[i] != other_comp[j]) & (np.minimum(n[i], other_n[j]) >= similarity * np.maximum(n[i], other_n[j]))
                    if right is None:
                        good &= i < j
                    i, j = i[good], j[good]
                    for k in range(sketch):
                        apart = keys[i, k] != other_keys[j, k]
                        i, j = i[apart], j[apart]
                    hit[i] = True
                    other_hit[j] = True
    return np.flatnonzero(hit), np.flatnonzero(other_hit)


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left x right) numbers of labelled shingles that two documents have in common."""
    n = len(left) + len(right)
    owner = np.repeat(np.arange(n), [len(x) for x in (*left, *right)])
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    on_left = owner < len(left)
    both = (np.bincount(code[on_left], minlength=len(values)) > 0) & (np.bincount(code[~on_left], minlength=len(values)) > 0)
    at = (np.cumsum(both) - 1)[code]
    held = both[code]
    order = np.argsort(at[held], kind="stable")
    owner, at = owner[held][order], at[held][order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(both.sum()), STEP_SHINGLES):
        i, j = np.searchsorted(at, [lo, lo + STEP_SHINGLES])
        has = np.zeros((n, STEP_SHINGLES), dtype=np.float32)
        has[owner[i:j], at[i:j] - lo] = 1.0
        out += has[: len(left)] @ has[len(left) :].T
    return out


def block_links(left: list[tuple], right: list[tuple] | None, key: int, similarity: float = SIMILARITY) -> list[tuple]:
    """Links (a, b, ca, cb) that join all similar pairs of two blocks of a bucket, or of one block
    (`right` is None), whose components differ; members are (id, component, keys, shingles).

    A pair that shares an earlier sketch is left to that bucket.
    """
    other = left if right is None else right
    if not left or not other or len({m[1] for m in (*left, *other)}) == 1:
        return []
    counts = common_shingles([m[3] for m in left], [m[3] for m in other])
    total = np.add.outer([len(m[3]) for m in left], [len(m[3]) for m in other])
    enough = counts >= np.ceil(similarity / (1 + similarity) * total - 1e-9)
    enough &= np.not_equal.outer([m[1] for m in left], [m[1] for m in other])
    if right is None:
        enough = np.triu(enough, 1)
    a, b = np.nonzero(enough)
    if not len(a):
        return []
    keys, other_keys = np.stack([m[2] for m in left]), np.stack([m[2] for m in other])
    sketch = int(np.argmax(keys[0] == key))
    here = ~(keys[a, :sketch] == other_keys[b, :sketch]).any(axis=1)
    a, b = a[here], b[here]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    # the most alike first: they join the most components before the others are looked at
    for i in np.argsort(-counts[a, b] / total[a, b], kind="stable").tolist():
        x, y = left[a[i]], other[b[i]]
        cx, cy = find(x[1]), find(y[1])
        if cx != cy and similar(x[3], y[3], similarity):
            parent[max(cx, cy)] = min(cx, cy)
            links.append((x[0], y[0], x[1], y[1]) if x[0] < y[0] else (y[0], x[0], y[1], x[1]))
    return links


def _in_blocks(members: DataFrame, most: int, most_shingles: int, run, columns: list[str], schema: str) -> DataFrame:
    """Every two blocks of a bucket in a group of their own: `run` takes (left members, right members or None, key)
    and returns rows.  `members` has key, id, n and the given columns."""
    placed = with_totals(members, ["key"], "id", m=(F.sum, F.lit(1)), total=(F.sum, F.col("n")))
    placed = placed.withColumn("blocks", F.ceil(F.greatest(F.col("m") / most, F.col("total") / most_shingles)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", "id"), "blocks"))
    each = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), (F.col("block") > F.col("with")).alias("second"), *columns)
    each = each.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides = None, ([], [])
        names = [c.split()[0] for c in schema.split(",")]

        def result() -> pa.RecordBatch:
            rows = run(sides[0], None if group[1] == group[2] else sides[1], group[0])
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(len(names))], names=names)

        def values(column: pa.Array) -> list:
            if pa.types.is_binary(column.type):
                return [np.frombuffer(v, np.uint8) for v in column.to_pylist()]
            if pa.types.is_list(column.type):
                return [v.values.to_numpy() for v in column]
            return column.to_pylist()

        for x in batches:
            second = x.column("second").to_pylist()
            members = list(zip(*(values(x.column(c)) for c in columns), strict=True))
            for r, now in enumerate(zip(*(x.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True)):
                if now != group:
                    if group is not None:
                        yield result()
                    group, sides = now, ([], [])
                sides[second[r]].append(members[r])
        if group is not None:
            yield result()

    return each.mapInArrow(stream, schema)


def _close_members(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The members (key, id, component, n, keys) that may be linked to a member of another component."""
    marks = _wanted(members, docs, parity_marks).withColumnsRenamed({"doc_id": "id", "seq": "marks"})
    marked = saved(members.join(marks.hint("merge"), "id"))

    def run(left: list[tuple], right: list[tuple] | None, key: int) -> list[tuple[int, int]]:
        i, j = close_members(left, right, key, similarity)
        other = left if right is None else right
        return [(key, left[x][0]) for x in i.tolist()] + [(key, other[x][0]) for x in j.tolist()]

    close = saved(_in_blocks(marked, MARKED_MEMBERS, MARKED_SHINGLES, run, ["id", "component", "keys", "n", "marks"], "key long, id long").distinct())
    forget(marked)
    return members.join(close, ["key", "id"], "left_semi")


def _block_links(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ca, cb): links that join all similar members of a bucket."""
    whole = saved(members.join(_wanted(members, docs).withColumnRenamed("doc_id", "id").hint("merge"), "id"))

    def run(left: list[tuple], right: list[tuple] | None, key: int) -> list[tuple]:
        sides = [None if side is None else [(*m[:3], m[3].view(np.uint64)) for m in side] for side in (left, right)]
        return block_links(sides[0], sides[1], key, similarity)

    return _in_blocks(whole, BLOCK_MEMBERS, BLOCK_SHINGLES, run, ["id", "component", "keys", "seq"], "a long, b long, ca long, cb long")


def _joined(comps: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component) after the links `found`, which are of different components: only the components are connected anew."""
    whole = connected(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    whole = whole.select(F.col("component").alias("whole"), F.col("id").alias("component"))
    return saved(comps.join(whole, "component", "left").select("id", F.coalesce("whole", "component").alias("component")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, component_id, kept) of every document: equal words, linked documents, and whether it is the one that stays."""
    every = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = every.where("doc_id is not null and text is not null")
    sketches = saved(_sketches(docs))
    key = ["c1", "c2"]
    led = saved(leaders(sketches.select("doc_id", *key), key, "doc_id"))

    # members of buckets with two representatives or more
    reps = saved(sketches.groupBy(*key).agg(F.min(F.struct("doc_id", "n", "keys")).alias("r")).select(F.col("r.doc_id").alias("id"), "r.n", "r.keys"))
    cells = reps.select("id", "n", F.explode(F.array_distinct("keys")).alias("key"))
    members = saved(with_totals(cells, ["key"], "id", size=(F.sum, F.lit(1))).where("size > 1"))
    hubs = members.groupBy("id").agg(F.sum("size").alias("hub"))
    head = F.struct("hub", (-F.col("id")).alias("minus"), "n")
    led_by = with_totals(members.join(hubs, "id"), ["key"], "id", head=(F.max, head)).select("id", "n", (-F.col("head.minus")).alias("lead"), F.col("head.n").alias("other_n"))
    found = saved(_led_links(led_by.where(F.col("id") != F.col("lead")).where(_long_enough(similarity)).select("id", "lead").distinct(), docs, similarity))
    comps = _joined(hubs.select("id", F.col("id").alias("component")), found.select(F.col("id").alias("ca"), F.col("lead").alias("cb")))

    # buckets that still hold several components are finished exactly
    now = with_totals(members.join(comps, "id"), ["key"], "id", lo=(F.min, F.col("component")), hi=(F.max, F.col("component")))
    open_members = saved(now.where("lo < hi").select("key", "id", "component").join(reps, "id"))
    forget(members, found)
    close = saved(_close_members(open_members, docs, similarity))
    forget(open_members)
    comps = _joined(comps, _block_links(close, docs, similarity))

    per_class = led.join(comps.withColumnRenamed("id", "leader"), "leader", "left").select(*key, "salt", F.col("leader").alias("class_id"), F.coalesce("component", "leader").alias("component_id"))
    judged = salted(sketches.select("doc_id", *key), "doc_id").join(per_class, [*key, "salt"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    out = every.select("doc_id").join(judged, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
