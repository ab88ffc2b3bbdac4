"""Periodic runs against a scan of every lag."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pingscape.llm import periodic
from pingscape.llm import text as tx
from tests.llm.helpers import CLASHING, documents


def every_run(words, min_words=6, min_exponent=4):
    out = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, q, n) for (s, n), q in out.items())


def found(texts, slice_bytes=1 << 14, **options):
    out = [[] for _ in texts]
    for lo, _, buf, offs in tx.slices(pa.array(texts, pa.string()), slice_bytes):
        begin, end, first = tx.words(buf, offs)
        for d, s, n, q in zip(*periodic.find_runs(tx.span_hashes(buf, begin, end), first, **options), strict=True):
            out[lo + int(d)].append((int(s), int(q), int(n)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_scan_of_every_lag(seed):
    rng, texts = random.Random(seed), []
    for _ in range(300):
        n = rng.choice([0, 1, 5, 6, 7, 30, 90, 300])
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 1000]))}" for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 6:
                a, p = rng.randrange(n), rng.randrange(1, n // 3 + 1)
                for i in range(a + p, min(n, a + p * rng.randrange(2, 9))):
                    words[i] = words[i - p]
        texts.append(" ".join(words))
    assert found(texts) == [every_run(t.split()) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 4, 5, 8, 9, 16, 17, 31, 33, 64, 100])
@pytest.mark.parametrize("short", [0, 1])
def test_lengths_at_the_bound(period, short):
    rng = random.Random(period)
    n = max(6, 4 * period) - short
    body = [f"p{rng.randrange(10**6)}" for _ in range(period)]
    words = ["left"] + [body[i % period] for i in range(n)] + ["right"]
    assert found([" ".join(words)]) == [[] if short else [(1, period, n)]]


def test_larger_thresholds():
    words = ("a b " * 5 + "x " + "c " * 7).split()
    assert found([" ".join(words)], min_words=8) == [every_run(words, 8)]
    assert found([" ".join(words)], min_exponent=6) == [every_run(words, 6, 6)]
    with pytest.raises(ValueError):
        found(["a"], min_exponent=3)


def test_a_long_text_is_one_slice_and_costs_little():
    body = " ".join(f"w{i}" for i in range(1000))
    assert found([" ".join([body] * 300)]) == [[(0, 1000, 300_000)]]
    assert found(["a " * 500_000 + "b"]) == [[(0, 1, 500_000)]]
    assert found(["x" * 3_000_000 + " y"]) == [[]]


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b c b c b c b c d"), (5, "ä ä " * 7)]
    df = documents(spark, rows, CLASHING + ["runs", "pos"])
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, [tuple(x) for x in r.runs], r.kept) for r in periodic.collapse_runs(df).collect())
    assert got == [(-1, 9, [(0, 8, 2)], "b c d"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (5, 7, [(0, 7, 1)], "ä ä")]
    assert periodic.collapse_runs(df.where("doc_id = 77")).count() == 0


def test_overlapping_runs_drop_what_any_run_covers(spark):
    text = "a b a b a b a b b b b b b"
    row = periodic.collapse_runs(documents(spark, [(1, text)])).first()
    runs = every_run(text.split())
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    assert [(r.start, r.period, r.length) for r in row.runs] == runs
    assert row.kept == " ".join(w for i, w in enumerate(text.split()) if i not in gone)


def test_query_plants_its_periods(spark):
    from zlib import crc32

    from pingscape.llm.catalog import _with_planted_period

    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 40))) for i in range(300)]
    got = {r.doc_id: r.text for r in _with_planted_period(documents(spark, rows)).collect()}
    planted = 0
    for i, text in rows:
        h, words = crc32(str(i).encode()), text.split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        assert got[i].split() == words
    assert planted > 10


def test_digest_of_a_document(spark, tmp_path):
    from pingscape.llm.catalog import op11_periodic_runs

    documents(spark, [(1, "x " + "a b c " * 4), (3, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    one, none = sorted(op11_periodic_runs(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 1, 12, 3, 4000)
    assert one.runs_sha256 == hashlib.sha256(b"1,12,3\n").hexdigest() and one.collapsed_sha256 == hashlib.sha256(b"x a b c").hexdigest()
    assert none.n_runs == 0 and none.start is None and none.exponent_milli is None and none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_minimizers_are_the_window_minima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 30, 200).astype(np.uint64)
    want = np.zeros(200, bool)
    for i in range(200 - 8 + 1):
        window = values[i : i + 8]
        want[i : i + 8] |= window == window.min()
    got = periodic._minimizers(values, 8)
    assert (got[7:-7] == want[7:-7]).all() and not (want & ~got).any()
