import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pingscape.llm import catalog, packing

from .helpers import CLASHING, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, length=packing.LENGTH):
    """Pieces tile every document and every sequence; ids are the library's."""
    t = library()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts:
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        at, got = 0, []
        for p in pieces:
            assert p["start"] == at and p["doc_tokens"] == len(want)
            at += p["length"]
            got += np.frombuffer(p["ids"], "<u4").tolist()
        assert got == want
    padding = tokens = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= length
        tokens += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding, tokens


def test_smoke_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding, tokens = check(packing.pack(docs, PATH).collect(), docs.select("doc_id", "text").collect())
    assert padding < 0.005 * tokens
    for r, q in zip(packing.pack(docs, PATH).orderBy("doc_id", "start").collect(), catalog.op2_packing(spark, sf).orderBy("doc_id", "start").collect(), strict=True):
        assert q["ids_crc32"] == zlib.crc32(r["ids"]) and q["length"] == r["length"]


def test_words_equal_the_library():
    rng = random.Random(2)
    letters = "abÉéßİıſKÅΣσς̃́'s-.,!_0９²¼ªº漢字かﬁ🙂ʰˠ\x85\xa0‍…—ǅ|#"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))).encode() for _ in range(40_000)}
    words = [w for w in words if w.split() == [w]]
    want = library().encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    encode = packing.TextEncoder(PATH)
    ids, lengths, _, first = encode([b" ".join(words)], np.array([False]))
    assert first.tolist() == [0, len(words)]
    ends = np.cumsum(lengths)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [w.ids for w in want]


def test_kinds_of_word_ends():
    words = ["a.", "a", "b,", 'c."', "d)", "e.)", "…", "f。", "g，", "h!!", "é", ".", "'", "x…y"]
    text = " ".join(words).encode()
    _, _, kinds, _ = packing.TextEncoder(PATH)([text], np.array([True]))
    S, C, W = packing.SENTENCE, packing.CLAUSE, packing.WORD
    assert kinds.tolist() == [S, W, C, S, C, S, S, S, C, S, W, S, W, W, packing.DOCUMENT]


def test_equal_words_get_equal_numbers(monkeypatch):
    from pingscape.llm import text as tx

    rng = random.Random(7)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    start, end, _ = tx.words(data, np.array([0, len(data)]))
    for spoil in (False, True):  # also where all words share few hashes
        if spoil:
            real = tx.span_hashes
            monkeypatch.setattr(tx, "span_hashes", lambda *a: real(*a) % np.uint64(5))
        number, at = packing._distinct(data, start, end)
        for i, w in enumerate(words):
            k = int(at[number[i]])
            assert words[k] == w or (spoil and len(w) > 16)
    assert packing._distinct(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []


def test_awkward_texts(spark):
    texts = [None, "", " \n\t", "<|endoftext|> x", "a" * 30_000, "x" * 9000 + " y", "Wörter, Ñandú.  \x1c\x85\xa0 don't 漢字🙂 é", "tok " * 20_000, "A. B! C?", "q|w|e"]
    rows = list(enumerate(texts)) + [(None, "no id")]
    check(packing.pack(documents(spark, rows, CLASHING), PATH).collect(), rows)


def test_repeated_ids_and_rows(spark):
    rows = [(1, "same text."), (1, "same text."), (1, "another")]
    got = packing.pack(documents(spark, rows), PATH).collect()
    t = library()
    want = [len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows]
    assert {r["doc_tokens"] for r in got} == set(want) and sum(r["length"] for r in got) == sum(want)
    assert sum(r["length"] for r in got if r["start"] == 0) <= sum(want) and sum(r["start"] == 0 for r in got) == 3


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []


def cost(path_ends, pos, price, length):
    ends = [0, *path_ends]
    worth = dict(zip(pos, price, strict=True))
    return sum(length - (b - a) + worth[b] for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_shortest_path(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 16, 50])
    pos = [0]
    while len(pos) < rng.randint(3, 40):
        pos.append(pos[-1] + rng.randint(1, length))
    price = [0.0] + [rng.choice([0.0, 1.0, 4.0, 8.0]) for _ in pos[1:]]
    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for i in range(1, len(pos)):
        for j in range(i):
            if pos[i] - pos[j] <= length:
                best[i] = min(best[i], best[j] + length - (pos[i] - pos[j]) + price[i])
    ends = packing.cuts(np.array(pos), np.array(price), length, last=False)
    got = [pos[i] for i in ends]
    first = next(i for i in range(len(pos)) if pos[-1] - pos[i] <= length)
    assert cost(got, pos, price, length) == pytest.approx(min(best[max(first, 1):]))
    assert all(b - a <= length for a, b in zip([0, *got], got, strict=False))


def test_rest_is_cut_at_powers_of_two():
    ends = packing.windows(np.array([5, 9, 11]), np.array([0.0, 0.0, 0.0]), 4096, True)
    assert np.diff(np.concatenate([[0], ends])).tolist() == [8, 2, 1]


def test_long_gaps_are_cut():
    ends = packing.windows(np.array([100_000]), np.array([0.0]), 4096, True)
    sizes = np.diff(np.concatenate([[0], ends]))
    assert sizes.sum() == 100_000 and sizes.max() <= 4096


def test_blocks_do_not_change_the_tiling(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma."]) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    encode, stream = packing.text_encoder(PATH), packing._Stream(512)
    pieces = []
    for i, t in rows:
        stream.add([i], [t.encode()], encode)
        if stream.size >= 5000:
            pieces += stream.flush(False)
    pieces += stream.flush(True)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    padding, tokens = check([dict(zip(names, p, strict=True)) for p in pieces], rows, 512)
    assert padding < 0.05 * tokens


def test_control_strings_are_coded_as_by_the_library(spark):
    rng = random.Random(9)
    parts = ["hello", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "world.", "\n", "it's", "9", "<|", "|>"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    check(packing.pack(documents(spark, texts), PATH).collect(), texts)


def test_rows_without_id_are_dealt_over_tasks(spark):
    rows = [(None, f"text number {i} " * 50) for i in range(400)]
    got = packing.pack(documents(spark, rows), PATH).collect()
    assert len({r["sequence_id"] >> 40 for r in got}) > 3
    assert sum(r["length"] for r in got) == sum(len(library().encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
