import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pingscape.llm import bpe, catalog

from .helpers import CLASHING, documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.run_encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def test_random_texts_equal_the_library(library, coder):
    rng = random.Random(3)
    letters = " \n\t\r\x1c\x1f\x85\xa0 　abcde'stlld0123éñü漢字🙂́.,!|#A"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = bpe.encode_texts(texts, coder)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_merges_that_make_lower_ranks_possible(library, coder):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abe") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 1500, "the" * 700 + "." * 999, " " * 500 + "x", "\n" * 300]
    assert [g.tolist() for g in bpe.encode_texts(texts, coder)] == [library.encode_ordinary(t) for t in texts]


def test_small_bounds_give_the_same_ids(library):
    coder = bpe.run_encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    coder._max = 20
    texts = [f"word{i % 37} and some, more {i}" for i in range(200)]
    got = [bpe.encode_texts([t], coder, limit=5)[0].tolist() for t in texts]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = catalog.op9_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark, library):
    rows = [(None, None), (1, ""), (1, ""), (2, "same"), (2, "same"), (3, "<|endoftext|>\x00"), (4, "long " * 50_000)]
    out = bpe.decode(bpe.encode(documents(spark, rows, CLASHING), PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in out) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert {r.doc_id: len(r.ids) // 4 for r in out}[4] == len(library.encode_ordinary(rows[-1][1]))


def test_empty_table(spark):
    assert bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def test_one_long_pre_token_costs_little(library, coder):
    import time

    rng = random.Random(5)
    for text in ("ab" * 200_000, "a" * 300_001, "the" * 100_000, "".join(rng.choice("abe") for _ in range(200_000)), "".join(map(chr, rng.choices(range(97, 123), k=300_000)))):
        start = time.time()
        got = bpe.encode_texts([text], coder)[0].tolist()
        assert time.time() - start < 5
        assert got == library.encode_ordinary(text)
