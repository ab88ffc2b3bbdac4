import random

import public_tokenizers
import pytest

from pingscape.llm import catalog, token_counts

from .helpers import CLASHING, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return token_counts.load_pieces(PATH)


def brute(word, pieces):
    """Best score, then fewest tokens, over all segmentations (quadratic)."""
    unknown = min(pieces.values()) - token_counts.UNKNOWN_COST
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + pieces[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in pieces]
        if word[e - 1] not in pieces:
            options.append((best[e - 1][0] + unknown, best[e - 1][1] - len(word[e - 1].encode())))
        best[e] = max(options)
    return -best[-1][1]


def test_words_equal_brute_force(spark, pieces):
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect() for w in r.text.split()}
    words |= {"漢字x🙂", "", "\x00", "aaaaaaaaaaaaaaaa", "éçà", "▁▁▁"}
    words = ["▁" + w for w in sorted(words)]
    random.Random(1).shuffle(words)
    counter = token_counts.TrieCounter(pieces)
    assert counter(words) == [brute(w, pieces) for w in words]
    assert counter.nodes < sum(map(len, words))  # prefixes are shared


def test_toy_vocabulary():
    toy = {"a": -1.0, "b": -1.0, "ab": -1.5, "abab": -9.0, "▁": -0.5, "▁a": -1.4}
    counter = token_counts.TrieCounter(toy)
    words = ["▁", "▁a", "▁ab", "▁abab", "▁abz", "▁zé", ""]
    assert counter(words) == [brute(w, toy) for w in words]


def test_query_sums_the_words(spark, pieces):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in catalog.op7_token_counts(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    known = {}
    for d in sorted(texts)[:40]:
        words = texts[d].encode().split()
        for w in words:
            if w not in known:
                known[w] = brute("▁" + w.decode(), pieces)
        assert (rows[d].n_words, rows[d].n_tokens) == (len(words), sum(known[w] for w in words))


def test_awkward_rows(spark, pieces):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "x x"), (3, "x x"), (4, "same " * 400_000), (5, "y" * 100_000)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts.count_tokens(documents(spark, rows, CLASHING), PATH).collect())
    x, same = brute("▁x", pieces), brute("▁same", pieces)
    assert got[:5] == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 2, 2 * x), (3, 2, 2 * x)]
    assert got[5] == (4, 400_000, 400_000 * same) and got[6][1] == 1


def test_bounded_store_gives_the_same_counts(pieces):
    words = [f"w{i % 50}".encode() for i in range(500)]
    small = token_counts.WordCounts(token_counts.TrieCounter(pieces), max_entries=7)
    got = [c for i in range(0, 500, 20) for c in small(words[i : i + 20]).tolist()]
    assert got == [brute("▁" + w.decode(), pieces) for w in words]


def test_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, []), PATH).collect() == []
