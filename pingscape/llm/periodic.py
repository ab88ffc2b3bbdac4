"""Periodic runs of words in whole texts, found by multi-scale minimizers.

Words are `[^\\x20\\x09-\\x0D]+`, compared by a 64-bit hash.  A run is a stretch of
consecutive words with smallest period q and a length of at least
max(min_words, min_exponent * q) that no neighbouring word extends keeping the period.

* Periods up to SHORT_PERIODS: a direct scan at each lag; a stretch of equal words
  at lag q is a run without its first q words.
* Longer periods, by scales: scale k = 8, 16, 32, ... is for periods in (k/2, k].
  Hashes of k words are doubled from those of k/2.  A position is a minimizer
  when its hash is the least of some window of k/2 positions.  In a run of
  period q, windows q apart hold the same words, so their minima lie q apart; and as
  k >= q, two equal hashes in the run lie a multiple of q apart.  So two
  neighbouring minimizers of one hash at a distance in (k/2, k] seed an extension: seeds
  of one distance that overlap are one chain, which is compared word for word and
  extended both ways.  With min_exponent >= 4 every run holds such a pair.
* Of stretches with one start and length the least period counts: all others are its multiples.

Cost is a few vector operations per word and scale, and a text takes part only in the
scales that its length allows; nothing depends on how many words repeat.

Defined results: a null or empty text has no words, no runs and an empty kept text; very
long texts are never cut (a text longer than `text.SLICE_BYTES` is a slice of its own, some
hundred bytes of memory a word); repeated rows and rows that share an id or have none
each give a row; an empty table gives an empty one.  Only the id and text columns are
read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm import text as tx
from pingscape.llm.slots import word_segments

MIN_WORDS = 6
MIN_EXPONENT = 4
SHORT_PERIODS = 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1342543DE82EF95)


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of True of at least `least`."""
    edge = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _doubled(grams: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from hashes of k words (meaningless where fewer words are left)."""
    out = grams * _STEP
    out[: max(0, len(grams) - k)] += grams[k:]
    return tx.mix(out)


def _minimizers(values: np.ndarray, window: int) -> np.ndarray:
    """Whether a position holds the least value of some window of `window` positions (a power of two)."""
    least, step = values.copy(), 1
    while step < window:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    # windows that hold the position begin at most window - 1 before it
    step = 1
    while step < window:
        least[step:] = np.maximum(least[step:], least[:-step])
        step *= 2
    return least == values


def _extended(h: np.ndarray, at: np.ndarray, lag: np.ndarray, bound: np.ndarray, way: int) -> np.ndarray:
    """How many more words equal those `lag` later, going from `at` up (way 1) or down (way -1), at most `bound`."""
    out = np.zeros(len(at), dtype=np.int64)
    active, width = np.flatnonzero(bound > 0), 16
    while len(active):
        ahead = np.arange(width)
        inside = ahead < (bound[active] - out[active])[:, None]
        spot = np.where(inside, at[active][:, None] + way * (out[active][:, None] + ahead), 0)
        same = inside & (h[spot] == h[np.where(inside, spot + lag[active][:, None], 0)])
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[active] += n
        active = active[n == width]
        width = min(1024, 2 * width)
    return out


def _chains(at: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, lag): stretches of equal words at a lag that overlapping seeds cover."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + k)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return at[head], at[last] + k, lag[head]


def find_runs(hashes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length, period) of all runs, ordered by document, start and period.

    `hashes` are the words of all documents one after the other, `first` says where each
    document begins (and the last one ends)."""
    if min_exponent < 4:
        raise ValueError("minimizer pairs are certain for exponents of 4 and more")
    count = np.diff(first)
    found = []
    for q in range(1, SHORT_PERIODS + 1):
        if len(hashes) <= q:
            break
        equal = hashes[:-q] == hashes[q:]
        # pairs that lie in two documents
        for back in range(1, q + 1):
            edge = first[1:-1] - back
            equal[edge[(edge >= 0) & (edge < len(equal))]] = False
        begin, end = _stretches(equal, max(min_words, min_exponent * q) - q)
        found.append((begin, end - begin + q, np.full(len(begin), q)))

    grams, left = hashes, np.repeat(first[1:], count) - np.arange(len(hashes))
    place, size = np.arange(len(hashes)), np.repeat(count, count)
    k = 1
    while True:
        grams, k = _doubled(grams, k), 2 * k
        if k <= SHORT_PERIODS:
            continue
        # a run of this scale has more than min_exponent * k / 2 words
        stay = size > min_exponent * k // 2
        if not stay.all():
            grams, left, place, size = grams[stay], left[stay], place[stay], size[stay]
        if not len(grams):
            break
        whole = left >= k
        values = np.where(whole, grams, _TOP)
        spots = np.flatnonzero(whole & _minimizers(values, k // 2))
        owner = place[spots] + left[spots]  # where the document ends
        order = np.lexsort((values[spots], owner))
        spots, owner = spots[order], owner[order]
        lag = spots[1:] - spots[:-1]
        pair = (values[spots[1:]] == values[spots[:-1]]) & (owner[1:] == owner[:-1]) & (lag > k // 2) & (lag <= k)
        if not pair.any():
            continue
        begin, end, lag = _chains(place[spots[:-1][pair]], lag[pair], k)
        # the chain word for word, then both ways
        length = end - begin
        flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        sure = np.logical_and.reduceat(hashes[flat] == hashes[flat + np.repeat(lag, length)], np.cumsum(length) - length)
        begin, end, lag = begin[sure], end[sure], lag[sure]
        doc = np.searchsorted(first, begin, side="right") - 1
        begin, end = begin - _extended(hashes, begin - 1, lag, begin - first[doc], -1), end + _extended(hashes, end, lag, first[doc + 1] - end - lag, 1)
        enough = end - begin + lag >= np.maximum(min_words, min_exponent * lag)
        found.append((begin[enough], (end - begin + lag)[enough], lag[enough]))

    start, length, period = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    if len(start):
        least = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
        start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    doc = np.searchsorted(first, start, side="right") - 1
    return doc, start - first[doc], length, period


def _kept(data: bytes, stay: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    out, at = [], 0
    for part in word_segments(data):
        if part:
            out.append(b" ".join(compress(part, stay[at : at + len(part)].tolist())))
            at += len(part)
    return b" ".join(x for x in out if x)


_RUN = "struct<start:long,length:long,period:long>"


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, n_words, runs, kept) of every row: its runs by start and period, and its words without those
    that lie in a run after the run's first period, joined by one space."""
    docs = df.select(F.col(id_col), F.col(text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tx.slices(b.column(1)):
                begin, end, first = tx.words(buf, offs)
                doc, start, length, period = find_runs(tx.span_hashes(buf, begin, end), first, min_words, min_exponent)
                # words covered after the first period of a run: +1 and -1 at the ends of each cover
                depth = np.zeros(len(begin) + 1, dtype=np.int64)
                np.add.at(depth, first[doc] + start + period, 1)
                np.add.at(depth, first[doc] + start + length, -1)
                stay = np.cumsum(depth)[:-1] == 0
                kept = [_kept(buf[offs[i] : offs[i + 1]].tobytes(), stay[first[i] : first[i + 1]]) for i in range(hi - lo)]
                each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "kept"])

    return docs.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, runs array<{_RUN}>, kept string")
