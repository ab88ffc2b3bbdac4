"""Byte-level BPE by replaying the merges over a whole slice of the corpus at once.

A task collects the distinct pre-tokens of its slice (those not met before), lays
their bytes end to end, and keeps an inverted index from the rank of a token pair
to the positions where that pair stands.  Ranks are taken in order; all positions
of a rank that do not overlap are merged at once, and only the two neighbours of each merge are
entered anew.  A pair that a merge creates can have a lower rank than the one in work: a
word's merges of a round end with the first that makes one, which is then taken first.  That keeps
the order of every word exactly that of the library's word-by-word loop, and the cost of a
long word in proportion to its length.

Texts are cut into runs of `white space? + non-space`, which no match of the split
pattern crosses; runs and pre-tokens are numbered and coded once per task.  Null
texts count as empty; an empty text has no ids; very long texts are coded in several calls and
never cut.  Repeated rows, and rows that share an id or have none, are rows of their own.  An empty
table gives an empty one.  Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm.slots import SlotTokens

#: Unicode White_Space, as the tokenizer's pattern understands \s (fixed values).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUN = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
SEGMENT_CHARS = 1 << 22
BATCH_ROWS = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file on the executor."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Codes lists of distinct pre-tokens (bytes) by applying the merges in rank order over all of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._ranks = ranks
        self._of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._keys = np.array(sorted(pairs), dtype=np.int64)
        self._made = np.array([pairs[k] for k in self._keys.tolist()], dtype=np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make; -1 where they make none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._made[at], -1)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        long: list[int] = []
        for i, w in enumerate(words):
            whole = self._ranks.get(w)
            if whole is not None:
                out[i] = [whole]
            elif not w:
                out[i] = []
            else:
                long.append(i)
        if long:
            lengths = np.array([len(words[i]) for i in long])
            token = self._replay(b"".join([words[i] for i in long]), lengths)
            left = token >= 0
            ends = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
            kept = token[left].tolist()
            for n, i in enumerate(long):
                out[i] = kept[ends[n] : ends[n + 1]]
        return out

    def _replay(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        """Tokens at their first bytes' positions, -1 elsewhere."""
        n = len(data)
        token = self._of_byte[np.frombuffer(data, np.uint8)]
        word = np.repeat(np.arange(len(lengths)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends - 1] = -1  # no pair crosses two words
        before[ends - lengths] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Add the pairs that begin at these positions to the index."""
            ranks = self._pair(token[places], token[after[places]])
            real = ranks >= 0
            places, ranks = places[real], ranks[real]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, some in zip(ranks[edges].tolist(), np.split(places, edges[1:]), strict=False):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(queue, r)

        enter(np.flatnonzero(after >= 0))
        while queue:
            rank = heapq.heappop(queue)
            held = index.pop(rank)
            places = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            places = places[(token[places] >= 0) & (after[places] >= 0)]
            places = places[self._pair(token[places], token[after[places]]) == rank]
            if not len(places):
                continue
            leading = np.diff(word[places], prepend=-1) != 0
            several = len(places) > 4 * int(leading.sum())
            if not several and not leading.all():
                # few positions a word: the first of each, the others in the next round
                index[rank] = [places[~leading]]
                heapq.heappush(queue, rank)
                places = places[leading]
            if several:
                # of overlapping positions (the second token of one is the first of the next) every other one from the left
                linked = np.append(False, after[places[:-1]] == places[1:])
                if linked.any():
                    nth = np.arange(len(places))
                    odd = (nth - np.maximum.accumulate(np.where(linked, 0, nth))) % 2 == 1
                    places = places[~odd]
                leading = np.diff(word[places], prepend=-1) != 0
                # the pairs that each merge makes when those to its left are done: may one come before the others?
                second = after[places]
                third = after[second]
                previous = before[places]
                joined = np.append(False, third[:-1] == places[1:])
                new = np.full(len(places), rank)
                lower = np.zeros(len(places), dtype=bool)
                right, left = third >= 0, previous >= 0
                made = self._pair(new[right], token[third[right]])
                lower[right] |= (made >= 0) & (made < rank)
                made = self._pair(np.where(joined[left], rank, token[previous[left]]), new[left])
                lower[left] |= (made >= 0) & (made < rank)
                # a word's merges up to its first such one
                stops = np.cumsum(lower) - lower
                head = np.flatnonzero(leading)
                wait = stops > np.repeat(stops[head], np.diff(np.append(head, len(places))))
                if wait.any():
                    index[rank] = [places[wait]]
                    heapq.heappush(queue, rank)
                    places = places[~wait]
            second = after[places]
            token[places], token[second] = rank, -1
            third = after[second]
            after[places] = third
            right = third >= 0
            before[third[right]] = places[right]
            left = before[places]
            touched = np.concatenate([left[left >= 0], places[right]])
            if several:  # neighbours of two merges
                touched = np.unique(touched)
            if len(touched):
                enter(touched)
        return token


def run_encoder(ranks: dict[bytes, int], pattern: str) -> SlotTokens:
    """Encoder of text runs: pre-tokens by the pattern, ids by merge replay."""
    split = regex.compile(pattern).findall
    pre = SlotTokens(MergeReplay(ranks))

    def encode(runs: list[str]) -> list[np.ndarray]:
        parts = [split(r) for r in runs]
        ids, lengths, _ = pre([p.encode("utf-8") for ps in parts for p in ps])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.cumsum([0, *map(len, parts)])
        bounds = ends[at].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    return SlotTokens(encode)


def text_runs(text: str, limit: int = SEGMENT_CHARS) -> Iterator[list[str]]:
    """The runs of one text, in lists of about `limit` characters."""
    if len(text) <= limit:
        yield RUN.findall(text)
        return
    held: list[str] = []
    size = 0
    for m in RUN.finditer(text):
        held.append(m.group())
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    yield held


def encode_texts(texts: list[str], coder: SlotTokens, limit: int = SEGMENT_CHARS) -> list[np.ndarray]:
    """Ids of each text; the runs of many texts are coded in one call, a very long text in several."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[str] = []
    ends: list[tuple[int, int]] = []

    def settle() -> None:
        ids, lengths, _ = coder(held)
        at = np.concatenate([[0], np.cumsum(lengths)])
        a = 0
        for owner, b in ends:
            out[owner].append(ids[at[a] : at[b]].astype("<u4"))
            a = b
        held.clear()
        ends.clear()

    size = 0
    for i, t in enumerate(texts):
        for runs in text_runs(t, limit):
            held.extend(runs)
            ends.append((i, len(held)))
            size += sum(map(len, runs)) if len(t) > limit else len(t)
            if size >= limit:
                settle()
                size = 0
    settle()
    return [np.concatenate(p) if p else np.zeros(0, "<u4") for p in out]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text as little-endian uint32 bytes."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            coder = coder or run_encoder(load_ranks(ranks_path), pattern)
            for at in range(0, b.num_rows, BATCH_ROWS):
                rows = b.slice(at, BATCH_ROWS)
                coded = encode_texts([t or "" for t in rows.column("text").to_pylist()], coder)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([c.tobytes() for c in coded], pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` (doc_id, ids) with the bytes that the ids stand for."""
    docs = df.select("doc_id", F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for b in batches:
            if lookup is None:
                lookup = {rank: token for token, rank in load_ranks(ranks_path).items()}.__getitem__
            texts = [b"".join(map(lookup, np.frombuffer(i.as_buffer(), "<u4").tolist())) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", out])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, {out} binary")
