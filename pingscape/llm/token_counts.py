"""Token counts by the best unigram segmentation, scored once per shared prefix.

Every word (a run of non-white-space, marked at its front as the vocabulary marks
word starts) is cut into vocabulary pieces with the greatest sum of scores; among
equal sums the fewest tokens count.  A character that no piece spells costs the
least piece score less UNKNOWN_COST and counts as its UTF-8 bytes.

A task inserts the distinct words of its slice, in sorted order, into a trie that is walked
depth first: the forward score of a prefix is computed when its node is first
entered and stands for every word below it.  Vocabulary pieces that end at a node
come from one automaton over the vocabulary (longest-suffix links), so a node
costs one step and its few matching pieces.  The count at a word's terminal node
is stored under the word; documents then sum stored counts.

Null and empty texts have no words and no tokens; repeated rows are counted one by
one; only the id and text columns are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm.slots import MAX_ENTRIES, Slots, word_segments

WORD_START = "▁"
UNKNOWN_COST = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in ids}


class PieceAutomaton:
    """All vocabulary pieces that end at a position, found by one step per character."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.found: list[tuple[tuple[int, float], ...]] = [()]
        for piece, score in pieces.items():
            state = 0
            for ch in piece:
                nxt = self.step[state].get(ch)
                if nxt is None:
                    nxt = self.step[state][ch] = len(self.step)
                    self.step.append({})
                    self.found.append(())
                state = nxt
            self.found[state] = ((len(piece), score),)
        self.back = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            self.found[state] += self.found[self.back[state]]
            for ch, nxt in self.step[state].items():
                self.back[nxt] = self.next(self.back[state], ch) if state else 0
                queue.append(nxt)

    def next(self, state: int, ch: str) -> int:
        while True:
            nxt = self.step[state].get(ch)
            if nxt is not None:
                return nxt
            if not state:
                return 0
            state = self.back[state]


class TrieCounter:
    """Token counts of lists of distinct words."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self._automaton = PieceAutomaton(pieces)
        self._unknown = (min(pieces.values()) if pieces else 0.0) - UNKNOWN_COST
        self.nodes = 0

    def __call__(self, words: list[str]) -> list[int]:
        """Counts in the given order; the trie is walked in sorted order, its open path on a stack."""
        step, found, unknown = self._automaton.next, self._automaton.found, self._unknown
        score, count, state = [0.0], [0], [0]
        out = [0] * len(words)
        path = ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            depth, least = 0, min(len(path), len(word))
            while depth < least and path[depth] == word[depth]:
                depth += 1
            del score[depth + 1 :], count[depth + 1 :], state[depth + 1 :]
            for d in range(depth, len(word)):
                ch = word[d]
                s = step(state[d], ch)
                best, fewest, spelled = -float("inf"), 0, False
                for length, worth in found[s]:
                    at = d + 1 - length
                    v, c = score[at] + worth, count[at] + 1
                    spelled = spelled or length == 1
                    if v > best or v == best and c < fewest:
                        best, fewest = v, c
                if not spelled:
                    v, c = score[d] + unknown, count[d] + len(ch.encode("utf-8"))
                    if v > best or v == best and c < fewest:
                        best, fewest = v, c
                score.append(best)
                count.append(fewest)
                state.append(s)
                self.nodes += 1
            path = word
            out[i] = count[len(word)]
        return out


class WordCounts:
    """Stored counts of a task's distinct words (emptied past its bound; counts are then made again)."""

    def __init__(self, counter: TrieCounter, max_entries: int = MAX_ENTRIES) -> None:
        self._counter, self._max = counter, max_entries
        self._slots, self._count = Slots(), np.zeros(1 << 14, dtype=np.int64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._slots) > self._max:
            self._slots = Slots()
        at = self._slots.numbers(words)
        fresh = self._slots.take_fresh()
        if fresh:
            n = len(self._slots)
            while n > len(self._count):
                self._count = np.concatenate([self._count, np.zeros_like(self._count)])
            self._count[n - len(fresh) : n] = self._counter([WORD_START + w.decode("utf-8") for w in fresh])
        return self._count[at]


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            counts = counts or WordCounts(TrieCounter(load_pieces(model_path)))
            words, tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            held: list[bytes] = []
            ends: list[tuple[int, int]] = []

            def settle() -> None:
                total = np.concatenate([[0], np.cumsum(counts(held))])
                a = 0
                for row, e in ends:
                    words[row] += e - a
                    tokens[row] += total[e] - total[a]
                    a = e
                held.clear()
                ends.clear()

            for i, t in enumerate(b.column("text")):
                text = t.as_buffer()
                if text is None:
                    continue
                for part in word_segments(text.to_pybytes()):
                    held.extend(part)
                    ends.append((i, len(held)))
                    if len(held) >= 1 << 18:
                        settle()
            settle()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
