"""Packing: documents, in order, cut into windows of at most `length` tokens.

Where to cut is a shortest path over candidate boundaries.  Ending a window at a
document's end is free; a truncated document costs `COSTS` (in tokens) by where it
is cut: after a sentence, a clause or a word (one word end in every WORD_STEP
tokens is offered), or inside a word (offered only where a single word is longer
than a window).  A window of t tokens costs length - t for its padding.  With f(i) the
least cost of covering the tokens before boundary i,

    f(i) = cut(i) + length - pos(i) + min { f(j) + pos(j) : pos(i) - pos(j) <= length },

a minimum over a sliding window, kept in a monotone queue: each boundary enters
and leaves it once.  Documents are range-partitioned by id and every partition is
packed on its own, as a stream: tokens are held for one block at a time, and the
path's open end is carried to the next block.  The rest of a partition (less than
a window) is cut at powers of two, which need no padding, where that is cheaper
than padding it.

Null and empty texts are one end token.  Rows that repeat an id are separate
documents, ordered by text; rows without id come first, ordered by a hash of their text, so that
many of them are dealt over many tasks.  A string of the tokenizer's file that is a token by itself
(an added token) is that token, as in the library's own call.  Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm import text as tx
from pingscape.llm.slots import text_segments

LENGTH = 4096
END_ID = 2
DOCUMENT, SENTENCE, CLAUSE, WORD, BROKEN = range(5)
COSTS = np.array([0.0, 1.0, 4.0, 8.0, 64.0])
TAIL_COST = 16.0
WORD_STEP = 16
BROKEN_STEP = 64
BLOCK_TOKENS = 1 << 18
CALL_ROWS = 2048
CALL_BYTES = 2 << 20

#: What the last byte of a word says about the boundary after it.
_KIND = np.full(256, WORD, dtype=np.int8)
_KIND[list(b".!?")] = SENTENCE
_KIND[list(b",;:|)]")] = CLAUSE
_QUOTE = np.zeros(256, dtype=bool)
_QUOTE[list(b"\"')]")] = True
_WIDE_KINDS = {int.from_bytes(c.encode(), "little"): k for k, cs in ((SENTENCE, "…。！？"), (CLAUSE, "，；：")) for c in cs}


def word_kinds(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What kind of boundary the end of each word is."""
    last = buf[end - 1]
    kinds = _KIND[last]
    # a closing quote or bracket after the end of a sentence
    kinds[_QUOTE[last] & (end - start > 1) & (_KIND[buf[np.maximum(end - 2, 0)]] == SENTENCE)] = SENTENCE
    wide = np.flatnonzero((last >= 128) & (end - start > 2))
    code = sum(buf[end[wide] - 3 + i].astype(np.int64) << (8 * i) for i in range(3))
    for c, k in _WIDE_KINDS.items():
        kinds[wide[code == c]] = k
    return kinds


SCHEMA = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_OWN_CASE = "\u0130"
#: ASCII marks that form one pre-token with their neighbours (an apostrophe may begin a contraction).
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[list(_MARKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MOST_MARKS = 16
#: Begins a word that stands for an added token; no text holds this byte.
ADDED = b"\xff"
#: Coded pieces that a worker process remembers.
MAX_PIECES = 200_000


class PieceEncoder:
    """Ids of word pieces by a tokenizer file (BPE with word ends).

    Letters alone and marks alone are single pre-tokens; they go straight to the
    tokenizer's model.  All other pieces go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self._whole.get_added_tokens_decoder().items() if t.content}
        self.added = re.compile(b"|".join(re.escape(c.encode()) for c in sorted(added, key=len, reverse=True))) if added else None
        self._added = {ADDED + str(i).encode(): [i] for i in added.values()}
        self.marks = {c.encode(): b" " + ADDED + str(i).encode() + b" " for c, i in added.items()}
        # pieces come in lower case and hold no added token any more, whatever they look like
        self._whole.encode_special_tokens = True
        self._model, self._normal = self._whole.model, self._whole.normalizer.normalize_str
        self._letters = _byte_letters()
        self._known: dict[bytes, list[int]] = {}

    def _pre_token(self, text: str) -> list[int]:
        shown = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(shown)]

    def _code(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8")
        if text.isascii():
            return self._pre_token(text.lower()) if text.isalpha() or not piece.strip(_MARKS) else self._by_library(text)
        if max(text) < _OWN_CASE:  # these letters are composed and have one lower-case letter each
            return self._pre_token(text.lower()) if text.isalpha() else self._by_library(text)
        normal = self._normal(text)
        return self._pre_token(normal) if normal.isalpha() else self._by_library(text)

    def _by_library(self, text: str) -> list[int]:
        return self._whole.encode(text, add_special_tokens=False).ids

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        known, code = self._known, self._code
        if len(known) > MAX_PIECES:
            known.clear()
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self._added.get(p) or code(p)
            out.append(ids)
        return out


def _stem_ends(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where each word splits into a piece and the marks after it: a place between a letter or digit and
    an ASCII mark is always between two pre-tokens.  The word's end where it has no such place."""
    at = end.copy()
    todo = np.flatnonzero(_IS_MARK[buf[end - 1]])
    for _ in range(MOST_MARKS):
        at[todo] -= 1
        todo = todo[at[todo] > start[todo]]
        todo = todo[_IS_MARK[buf[at[todo] - 1]]]
        if not len(todo):
            break
    at[todo] = start[todo]  # many marks: left whole
    last, before = buf[np.maximum(at - 1, 0)], buf[np.maximum(at - 2, 0)]
    letter = (last >= 97) & (last < 123) | (last >= 48) & (last < 58) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return np.where((at > start) & letter, at, end)


class TextEncoder:
    """Ids of whole texts for a tokenizer that ignores case and drops white space.

    Such a tokenizer never joins text across white space, nor letters and the marks
    after them, so the ids of a text are the ids of these pieces one after the other
    (tests hold this against whole texts).  The equal pieces of a block are found by
    sorting their hashes, and every distinct one is coded once.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        self._pieces, self._end_id = PieceEncoder(path), end_id

    def __call__(self, texts: list[bytes], closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, kinds, first) for a list of texts: all ids; per word its number of ids and
        the kind of its end; the first word of each text.  `closed` texts end with the end id, as a last word."""
        whole = b"".join(texts)
        if self._pieces.added and self._pieces.added.search(whole):
            # an added token ends the words around it, like white space
            texts = [self._pieces.added.sub(lambda m: self._pieces.marks[m[0]], t) for t in texts]
            whole = b"".join(texts)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        buf = _LOWER[np.frombuffer(whole, np.uint8)]
        start, end, first = tx.words(buf, offs)
        split = _stem_ends(buf, start, end)
        two = split < end
        place = np.cumsum(1 + two) - (1 + two)  # first piece of each word
        begin, stop = np.empty(len(start) + int(two.sum()), np.int64), np.empty(len(start) + int(two.sum()), np.int64)
        begin[place], stop[place] = start, split
        begin[place[two] + 1], stop[place[two] + 1] = split[two], end[two]
        number, at = _distinct(buf, begin, stop)
        data = buf.tobytes()
        coded = self._pieces([data[i:j] for i, j in zip(begin[at].tolist(), stop[at].tolist(), strict=True)])
        coded.append([self._end_id])
        length = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        flat = np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=int(length.sum()))
        origin = np.cumsum(length) - length
        # the end id is one more piece, and one more word, after each closed text
        piece_first = np.append(place, len(begin))[first]
        number = np.insert(number, piece_first[1:][closed], len(coded) - 1)
        per_word = np.insert((1 + two).astype(np.int64), first[1:][closed], 1)
        kinds = np.insert(word_kinds(buf, start, end), first[1:][closed], DOCUMENT)
        first = first + np.concatenate([[0], np.cumsum(closed)])
        lengths = length[number]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(origin[number] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        word_ends = ends[np.cumsum(per_word) - 1] if len(per_word) else ends
        return ids, np.diff(word_ends, prepend=0), kinds, first


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's text, a place of each number): equal words get equal numbers.

    Words are told apart by a 64-bit hash, and by length and first and last eight
    bytes: exact for words up to sixteen bytes."""
    length = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(len(buf) + 1, 8), strides=(1, 1))
    low = np.full(9, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    low[:8] = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    keep = low[np.minimum(length, 8)]
    head = np.ascontiguousarray(eight[start]).view("<u8").ravel() & keep
    tail = np.ascontiguousarray(eight[np.maximum(start, end - 8)]).view("<u8").ravel() & keep
    mixed = tx.span_hashes(buf, start, end)
    _, at, number = np.unique(mixed, return_index=True, return_inverse=True)
    same = at[number]
    odd = np.flatnonzero((length != length[same]) | (head != head[same]) | (tail != tail[same]))
    if len(odd):  # two words share a hash: such words get numbers of their own
        at = np.concatenate([at, odd])
        number[odd] = len(at) - len(odd) + np.arange(len(odd))
    return number, at


_encoders: dict[tuple[str, int], TextEncoder] = {}


def text_encoder(path: str, end_id: int = END_ID) -> TextEncoder:
    """One encoder for all tasks of a worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = TextEncoder(path, end_id)
    return _encoders[path, end_id]


def cuts(pos: np.ndarray, cost: np.ndarray, length: int, last: bool) -> list[int]:
    """Indexes of the chosen boundaries after boundary 0, in order.

    `pos` are the boundaries' token positions (strictly increasing, gaps at most
    `length`), `cost` what a cut there costs.  With `last` the path ends at the
    final boundary; otherwise at the cheapest boundary within the last window.
    """
    m = len(pos)
    at, cut = pos.tolist(), cost.tolist()
    f, back = [0.0] * m, [0] * m
    # the queue: boundaries with increasing f(j) + pos(j), the live part from `head` on
    worth, where, head = [float(at[0])], [0], 0
    for i in range(1, m):
        p = at[i]
        low = p - length
        while at[where[head]] < low:
            head += 1
        best = worth[head] + cut[i] + length
        f[i], back[i] = best - p, where[head]
        while len(worth) > head and worth[-1] >= best:
            worth.pop()
            where.pop()
        worth.append(best)
        where.append(i)
    first = int(np.searchsorted(pos, pos[-1] - length, side="left"))
    if last:
        def total(j: int) -> float:
            rest = at[-1] - at[j]
            return f[j] - cut[j] * (rest == 0) + min((length - rest) if rest else 0, TAIL_COST * bin(rest).count("1"))

        end = min(range(first, m), key=total)
    else:
        end = min(range(max(first, 1), m), key=lambda j: (f[j], -j))
    path = []
    j = end
    while j:
        path.append(j)
        j = back[j]
    return path[::-1]


def boundaries(stops: np.ndarray, cost: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate positions without gaps over `length`: broken cuts are offered inside longer stretches."""
    gap = np.diff(stops, prepend=0)
    wide = np.flatnonzero(gap > length)
    if not len(wide):
        return stops, cost
    extra = np.concatenate([np.arange(stops[w] - gap[w] + BROKEN_STEP, stops[w], BROKEN_STEP) for w in wide])
    pos = np.concatenate([stops, extra])
    order = np.argsort(pos, kind="stable")
    return pos[order], np.concatenate([cost, np.full(len(extra), COSTS[BROKEN])])[order]


def windows(stops: np.ndarray, cost: np.ndarray, length: int, last: bool) -> np.ndarray:
    """Ends of the windows that cover the stream from 0 (up to its end if `last`)."""
    pos, price = boundaries(stops, cost, length)
    pos, price = np.concatenate([[0], pos]), np.concatenate([[0.0], price])
    ends = [int(pos[j]) for j in cuts(pos, price, length, last)]
    if last:
        rest = int(pos[-1]) - (ends[-1] if ends else 0)
        if rest and length - rest > TAIL_COST * bin(rest).count("1"):
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    ends.append((ends[-1] if ends else 0) + (1 << bit))
        elif rest:
            ends.append(int(pos[-1]))
    return np.array(ends, dtype=np.int64)


class _Stream:
    """Tokens of whole documents not yet written, with their boundaries."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.ids: list[np.ndarray] = []
        self.stops: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # id, position of its first token (may be negative), tokens
        self.size = 0
        self.begun = 0  # where the next document begins
        self.sequence = 0

    def add(self, doc_ids: list, texts: Iterable[bytes], encode: TextEncoder) -> None:
        """Whole documents; many are coded in one call, a very long text in several."""
        held: list[tuple[bytes, object, bool]] = []  # piece of a text, its document, whether it is the last one
        size = 0
        for doc_id, text in zip(doc_ids, texts, strict=True):
            pieces = list(text_segments(text, CALL_BYTES))
            for n, piece in enumerate(pieces, 1):
                held.append((piece, doc_id, n == len(pieces)))
                size += len(piece)
                if size >= CALL_BYTES:
                    self._settle(held, encode)
                    held, size = [], 0
        self._settle(held, encode)

    def _settle(self, held: list[tuple[bytes, object, bool]], encode: TextEncoder) -> None:
        closed = np.array([last for _, _, last in held], dtype=bool)
        ids, lengths, kinds, first = encode([piece for piece, _, _ in held], closed)
        ends = self.size + np.cumsum(lengths)
        offered = (kinds != WORD) | (ends // WORD_STEP != (ends - lengths) // WORD_STEP)
        offered &= lengths > 0
        self.ids.append(ids)
        self.stops.append(ends[offered])
        self.costs.append(COSTS[kinds[offered]])
        last_word = first[1:][closed] - 1
        for doc_id, end in zip([d for _, d, last in held if last], ends[last_word].tolist(), strict=True):
            self.docs.append((doc_id, self.begun, end - self.begun))
            self.begun = end
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled; the rest stays."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        stops, price = np.concatenate(self.stops), np.concatenate(self.costs)
        stops, keep = np.unique(stops, return_index=True)
        price = price[keep]
        ends = windows(stops, price, self.length, last)
        out = []
        done = int(ends[-1]) if len(ends) else 0
        begins = np.concatenate([[0], ends[:-1]])
        starts = np.array([d[1] for d in self.docs], dtype=np.int64)
        pieces = np.unique(np.concatenate([begins, starts[(starts >= 0) & (starts < done)], [0]]))
        piece_ends = np.append(pieces[1:], done)
        doc_of = np.searchsorted(starts, pieces, side="right") - 1
        window_of = np.searchsorted(begins, pieces, side="right") - 1
        base = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        for a, b, d, w in zip(pieces.tolist(), piece_ends.tolist(), doc_of.tolist(), window_of.tolist(), strict=True):
            if b > a:
                doc_id, begin, tokens = self.docs[d]
                out.append((doc_id, a - begin, b - a, tokens, base + self.sequence + w, a - int(begins[w]), ids[a:b].astype("<u4").tobytes()))
        self.sequence += len(ends)
        self.ids = [ids[done:]]
        self.stops, self.costs = [stops[stops > done] - done], [price[stops > done]]
        self.docs = [(i, p - done, n) for i, p, n in self.docs if p + n > done]
        self.size -= done
        self.begun -= done
        return out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of the packed sequences: which ids of which document lie where, and the ids (little-endian uint32)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    docs = docs.repartitionByRange(parts, "doc_id", deal).sortWithinPartitions("doc_id", deal, "text")
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stream, types = None, _Stream(length), None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        for b in batches:
            if encode is None:
                encode = text_encoder(tokenizer_path, end_id)
                types = [b.schema.field("doc_id").type, *[pa.int64()] * 5, pa.binary()]
            for at in range(0, b.num_rows, CALL_ROWS):
                part = b.slice(at, CALL_ROWS)
                texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text"))
                stream.add(part.column("doc_id").to_pylist(), texts, encode)
                if stream.size >= BLOCK_TOKENS:
                    rows = stream.flush(False)
                    if rows:
                        yield table(rows)
        rows = stream.flush(True)
        if rows:
            yield table(rows)
        tx.give_back()

    return docs.mapInArrow(run, schema)
