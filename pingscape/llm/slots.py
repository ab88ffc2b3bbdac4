"""Distinct words of a task's slice of the corpus, numbered, with their token ids side by side.

A task sees most words many times.  `Slots` numbers each distinct word once;
`SlotTokens` keeps the token ids of word i in one flat array, so that the ids of
a whole slice are one gather.  Both are emptied when they pass their bound, which
costs re-encoding and never changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np

MAX_ENTRIES = 200_000
MAX_IDS = 4_000_000
SEGMENT_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x09-\x0D\x20]")


class Slots(dict):
    """word -> number; a word not seen before is appended to `fresh`."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: Sequence) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def take_fresh(self) -> list:
        out, self.fresh = self.fresh, []
        return out


class SlotTokens:
    """Token ids of numbered words, and a small number that `mark` gives each word.

    `encode` maps a list of new words to a list of id sequences."""

    def __init__(self, encode: Callable[[list], list[Sequence[int]]], mark: Callable[[list], list[int]] | None = None, max_entries: int = MAX_ENTRIES) -> None:
        self._encode, self._mark_of, self._max = encode, mark, max_entries
        self._clear()

    def _clear(self) -> None:
        self.slots = Slots()
        self._ids = np.zeros(1 << 16, dtype=np.int32)
        self._start = np.zeros(1 << 14, dtype=np.int64)
        self._length = np.zeros(1 << 14, dtype=np.int64)
        self._mark = np.zeros(1 << 14, dtype=np.int8)
        self._used = 0

    def _append(self, words: list) -> None:
        coded = self._encode(words)
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        n0, n1, total = len(self.slots) - len(words), len(self.slots), int(lengths.sum())
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while n1 > len(self._length):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
            self._length = np.concatenate([self._length, np.zeros_like(self._length)])
            self._mark = np.concatenate([self._mark, np.zeros_like(self._mark)])
        self._ids[self._used : self._used + total] = np.fromiter((i for c in coded for i in c), dtype=np.int32, count=total)
        self._start[n0:n1] = self._used + np.cumsum(lengths) - lengths
        self._length[n0:n1] = lengths
        if self._mark_of:
            self._mark[n0:n1] = self._mark_of(words)
        self._used += total

    def __call__(self, words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word, mark of each word)."""
        if len(self.slots) > self._max or self._used > MAX_IDS:
            self._clear()
        at = self.slots.numbers(words)
        if self.slots.fresh:
            self._append(self.slots.take_fresh())
        length = self._length[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(self._start[at] - (ends - length), length) + np.arange(total)], length, self._mark[at]


def text_segments(data: bytes, limit: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """One text in pieces of about `limit` bytes, cut at white space."""
    at = 0
    while len(data) - at > limit:
        cut = _SPACE.search(data, at + limit)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def word_segments(data: bytes, limit: int = SEGMENT_BYTES) -> Iterator[list[bytes]]:
    """The words of one text in lists of about `limit` bytes of text, so a very long text is never split at once."""
    for part in text_segments(data, limit):
        yield part.split()
