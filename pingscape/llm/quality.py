"""Quality rules: text statistics, and a decision list learned from labelled documents.

`text_statistics` makes one pass over the texts.  `learn_rules` grows and prunes
threshold conjunctions by sequential covering on a bounded labelled sample, and
`DecisionList.verdict` emits them as one ordered Spark conditional expression, so
that applying the rules is ordinary column arithmetic.

Null and empty texts have no words; a document without words gets ratios of 0.
Repeated rows are judged one by one.  Extra columns of the input never clash:
the statistics travel in one struct column under a free name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingscape.llm import text as tx
from pingscape.llm.storage import free_name

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])

#: Ratios that the learned rules test, each from two of the counts.
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}

REPEAT_WINDOW = 5
#: At most this many labelled documents are fitted on (those with the smallest id hashes).
MAX_LABELLED = 20_000


def _byte_class(chars: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOLS = _byte_class(b"#*$%&|<>")
_UPPER = _byte_class(range(65, 91))
_DIGITS = _byte_class(range(48, 58))
_MARKS = _byte_class(b"!\"'(),-./:;?[]{}")


def _repeat_words(buf, start, end, first) -> np.ndarray:
    """Words per document that lie in a window of five words found twice or more in it."""
    n = len(start)
    grams = tx.gram_hashes(tx.span_hashes(buf, start, end), REPEAT_WINDOW)
    valid, doc = tx.inside_document(first, REPEAT_WINDOW)
    at = np.flatnonzero(valid)
    key = tx.mix(grams[at] + tx.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(n, dtype=bool)
    found[at[order[1:][same]]] = True
    found[at[order[:-1][same]]] = True
    covered = found.copy()
    for j in range(1, REPEAT_WINDOW):
        covered[j:] |= found[: n - j] if j < n else False
    return tx.per_document(covered, first)


def _dup_lines(buf, offs, word_start) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word that equal an earlier line, lines with a word) per document."""
    start, end, doc = tx.lines(buf, offs)
    has = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, doc = start[has], end[has], doc[has]
    n_docs = len(offs) - 1
    total = np.bincount(doc, minlength=n_docs)
    # lines less the distinct ones, each counted at its first line in the slice
    keys = tx.mix(tx.span_hashes(buf, start, end) + tx.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(keys, return_index=True)
    return total - np.bincount(doc[at], minlength=n_docs), total


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of STATS_TYPE for each text of an Arrow array."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, _, buf, offs in tx.slices(texts):
        start, end, first = tx.words(buf, offs)
        dup, n_lines = _dup_lines(buf, offs, start)
        code_points = (buf & 0xC0) != 0x80
        got = {
            "n_words": np.diff(first),
            "word_chars": tx.per_document(code_points & ~tx._SPACE[buf], offs),
            "n_symbols": tx.per_document(_SYMBOLS[buf], offs),
            "n_dup_lines": dup,
            "n_repeat_words": _repeat_words(buf, start, end, first),
            "n_lines": n_lines,
            "n_upper": tx.per_document(_UPPER[buf], offs),
            "n_digits": tx.per_document(_DIGITS[buf], offs),
            "n_marks": tx.per_document(_MARKS[buf], offs),
        }
        for c, v in got.items():
            parts[c].append(v)
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in parts.items()}


def text_statistics(df: DataFrame, text_col: str = "text", out: str | None = None) -> tuple[DataFrame, str]:
    """`df` with one more struct column of counts; returns the frame and the column's name."""
    out = free_name(df.columns, out or "text_stats")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts = statistics_of(b.column(text_col))
            stats = pa.StructArray.from_arrays([pa.array(counts[c]) for c in COUNTS], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, stats], names=[*b.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, STATS_TYPE, False)])
    return df.mapInArrow(batches, schema), out


def feature(name: str, stats: str) -> Column:
    """A ratio of FEATURES as a column; 0 where the denominator is 0."""
    top, bottom = (F.col(f"`{stats}`.{c}").cast("double") for c in FEATURES[name])
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def base_failed(stats: str) -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    n, r = (F.col(f"`{stats}`.{c}") for c in ("n_words", "n_repeat_words"))
    return (n < 10) | (100 * r > 20 * n)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); a document that meets all is rejected."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), dtype=bool)
        for f, op, t in self.conditions:
            hit &= x[f] <= t if op == "<=" else x[f] > t
        return hit


@dataclass
class DecisionList:
    """Ordered reject rules; a document that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self, stats: str) -> Column:
        """True where the document is kept: WHEN rule 1 THEN false WHEN rule 2 ... ELSE true."""
        out: Column | None = None
        for r in self.rules:
            cond = F.lit(True)
            for f, op, t in r.conditions:
                c = feature(f, stats)
                cond = cond & ((c <= F.lit(t)) if op == "<=" else (c > F.lit(t)))
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def keeps(self, x: dict[str, np.ndarray]) -> np.ndarray:
        kept = np.ones(len(next(iter(x.values()))), dtype=bool)
        for r in self.rules:
            kept &= ~r.covers(x)
        return kept


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, max_thresholds: int) -> list[tuple[str, str, float]]:
    """Add the condition with the best information gain until no good document is covered."""
    hit = np.ones(len(bad), dtype=bool)
    conditions: list[tuple[str, str, float]] = []
    while len(conditions) < max_conditions:
        p0, n0 = int(bad[hit].sum()), int((~bad[hit]).sum())
        if not p0 or not n0:
            break
        before = np.log2(p0 / (p0 + n0))
        best: tuple[float, tuple[str, str, float] | None] = (0.0, None)
        for f, values in x.items():
            v, b = values[hit], bad[hit]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, max_thresholds + 1)[1:-1], method="lower"))
            order = np.argsort(v, kind="stable")
            ranked = v[order]
            below = np.searchsorted(ranked, cuts, side="right")
            # the threshold stands midway to the next value, so unseen documents near a cut are not all on one side
            middle = (cuts + ranked[np.minimum(below, len(v) - 1)]) / 2
            bads = np.concatenate([[0], np.cumsum(b[order])])
            for op, p, n in (("<=", bads[below], below), (">", p0 - bads[below], len(v) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - before), 0.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (f, op, float(middle[i])))
        if best[1] is None:
            break
        conditions.append(best[1])
        f, op, t = best[1]
        hit &= x[f] <= t if op == "<=" else x[f] > t
    return conditions


def _prune(conditions: list[tuple[str, str, float]], x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, min_precision: float) -> Rule | None:
    """The leading conditions with the largest (bad - good) / covered on the `held` rows, the shorter at
    a tie, among those precise enough over all rows; None if none is."""
    best, worth = None, -2.0
    for k in range(len(conditions), 0, -1):
        r = Rule(tuple(conditions[:k]))
        hit = r.covers(x)
        if not hit.any() or bad[hit].mean() < min_precision:
            continue
        p, n = int(bad[hit & held].sum()), int((~bad[hit & held]).sum())
        w = (p - n) / (p + n) if p + n else -1.0
        if w >= worth:
            best, worth = r, w
    return best


def learn_rules(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    min_precision: float = 0.95,
    min_held_out: float = 0.8,
    min_support: int = 5,
    max_rules: int = 32,
    max_conditions: int = 4,
    max_thresholds: int = 256,
    seed: int = 17,
) -> DecisionList:
    """Sequential covering over labelled rows.

    Each rule is grown on two thirds of what is left and pruned on the other
    third; covering ends when a rule covers fewer than `min_support` bad rows, or
    its share of bad rows is under `min_precision` over both parts or under
    `min_held_out` on the third it was not grown on.  Without labelled rows, or with
    one class only, the list is empty (all are kept).
    """
    rules: list[Rule] = []
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules and bad[left & grow].any():
        part = lambda m: {f: v[m] for f, v in x.items()}
        g = left & grow
        conditions = _grow(part(g), bad[g], max_conditions, max_thresholds)
        if not conditions:
            break
        rule = _prune(conditions, part(left), bad[left], ~grow[left], min_precision)
        if rule is None:
            break
        hit = rule.covers(x) & left
        held_out = hit & ~grow
        if bad[hit].sum() < min_support or (held_out.any() and bad[held_out].mean() < min_held_out):
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and bad flags of at most `max_labelled` labelled documents (smallest id hashes).

    Labels without id or quality are ignored; a label row that repeats an id
    counts as a row of its own, up to the bound.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("label_id"), (F.col("quality") == 0).alias("bad"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id", "bad").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("label_text"))
    stats, name = text_statistics(texts.join(F.broadcast(ids), "label_id"), "label_text")
    rows = stats.select("label_id", "bad", *[feature(f, name).alias(f) for f in FEATURES]).orderBy("label_id", "bad", *FEATURES).limit(2 * max_labelled).toArrow()
    return {f: rows[f].to_numpy() for f in FEATURES}, rows["bad"].to_numpy(zero_copy_only=False).astype(bool)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, str, Column]:
    """(docs with statistics, the statistics column, verdict): base rule and learned list together."""
    rules = learn_rules(*labelled_sample(docs, labels, id_col, text_col), **options)
    stats, name = text_statistics(docs, text_col)
    return stats, name, ~base_failed(name) & rules.verdict(name)
