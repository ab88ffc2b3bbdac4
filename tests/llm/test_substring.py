import hashlib
import random

import numpy as np
import pytest

from pingscape.llm import catalog, substring

from .helpers import CLASHING, documents


def brute(rows, n=20):
    """{id: (words, removed flags)} by windows of words."""
    first, flags = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    words = [(t or "").encode().split() for _, t in rows]
    for k in order:
        for i in range(len(words[k]) - n + 1):
            spot = (rows[k][0] if rows[k][0] is not None else float("-inf"), i)
            key = tuple(words[k][i : i + n])
            first[key] = min(first.get(key, spot), spot)
    for k, (d, _) in enumerate(rows):
        gone = [False] * len(words[k])
        for i in range(len(words[k]) - n + 1):
            if first[tuple(words[k][i : i + n])] < (d if d is not None else float("-inf"), i):
                gone[i : i + n] = [True] * n
        flags.append(gone)
    return [(len(w), sum(g), b" ".join(x for x, y in zip(w, g, strict=True) if not y).decode()) for w, g in zip(words, flags, strict=True)]


def run(spark, rows, extra=(), **options):
    df, out = substring.without_repeats(documents(spark, rows, extra), **options)
    return [(r["doc_id"], r[out].n_words, r[out].n_removed, r[out].kept) for r in df.collect()]


def random_rows(seed, vocabulary):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 35, 60]))] for _ in range(6)]
    rows = []
    for d in range(40):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((rng.randint(0, 10**6) * 100 + d, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, [f"w{i}" for i in range(500)]), (2, ["a", "b", "c"]), (3, ["a"])])
def test_random_texts_equal_brute_force(spark, seed, vocabulary):
    rows = random_rows(seed, vocabulary)
    want = [(d, *b) for (d, _), b in zip(rows, brute(rows), strict=True)]
    assert sorted(run(spark, rows, CLASHING)) == sorted(want)


def test_full_table_of_bits_changes_nothing(spark):
    rows = random_rows(4, [f"w{i}" for i in range(200)])
    want = [(d, *b) for (d, _), b in zip(rows, brute(rows), strict=True)]
    assert sorted(run(spark, rows, table_bits=1 << 15)) == sorted(want)


def test_many_batches_equal_one(spark):
    rows = random_rows(5, [f"w{i}" for i in range(80)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted((d, *b) for (d, _), b in zip(rows, brute(rows), strict=True))


def test_awkward_rows(spark):
    p = " ".join(f"w{i}" for i in range(25))
    rows = [(None, p), (None, p), (None, None), (1, None), (2, ""), (3, p + " tail"), (3, p + " tail"), (3, "other " + p), (4, "é\x85 " * 12 + p), (5, "x " * 30_000), (6, " ".join(p.split()[:19]))]
    want = [(d, *b) for (d, _), b in zip(rows, brute(rows), strict=True)]
    assert sorted(run(spark, rows), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_text_keeps_its_layout(spark):
    p = "\n".join(f"w{i}" for i in range(30))
    df, out = substring.without_repeats(documents(spark, [(1, p), (2, f"before \t this\n{p}\n\nand  after")]))
    texts = {r["doc_id"]: r[out].text for r in df.collect()}
    assert texts == {1: p, 2: "before \t this\nand  after"}


def test_query_equals_brute_force_on_the_smoke_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op6_substring_dedup(spark, sf).collect()}
    assert got == {d: (n, m, hashlib.sha256(k.encode()).hexdigest()) for (d, _), (n, m, k) in zip(rows, brute(rows), strict=True)}


def test_equal_windows_choose_equal_anchors():
    import pyarrow as pa

    from pingscape.llm import text as tx

    rng = random.Random(8)
    p = [f"w{rng.randint(0, 50)}" for _ in range(20)]
    seen = set()
    for _ in range(50):
        left, right = ([f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 30))] for _ in range(2))
        _, _, buf, offs = next(tx.slices(pa.array([" ".join(left + p + right)])))
        o = substring.occurrences(buf, offs, 20, 8)
        k = int(np.flatnonzero((o["start"] <= len(left)) & (len(left) < o["start"] + o["n"]))[0])
        seen.add(int(o["anchor"][k]))
    assert len(seen) == 1
