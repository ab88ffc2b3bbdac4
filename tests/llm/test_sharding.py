import zlib
from collections import Counter

import numpy as np
import pytest

from pingscape.llm import catalog, sharding

from .helpers import CLASHING, documents


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 255, 256, 257, 5000])
def test_permutation_and_its_inverse(n):
    p = sharding.permute(np.arange(n), n, 20)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.row_at(p % 24, p // 24, n, 24, 20) == np.arange(n)).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog.op8_sharding(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    n = len(texts)
    assert len(rows) == n
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    place = {d: i for i, d in enumerate(sorted(texts, key=lambda d: d))}
    want = sharding.permute(np.arange(n), n, 20)
    assert all(want[place[r.doc_id]] == r.slot * 24 + r.shard for r in rows)


def test_reproducible(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(300)])
    a = sharding.shard_rows(docs, 7).collect()
    b = sharding.shard_rows(docs.repartition(5), 7).collect()
    assert sorted(a) == sorted(b)


def test_awkward_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (None, "x"), (2, "é"), (2, "é"), (3, "z" * 100_000)]
    got = sharding.shard_rows(documents(spark, rows, CLASHING), 3).collect()
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((p % 3, p // 3) for p in range(len(rows)))
    assert {r["size"] for r in got if r["doc_id"] == 1} == {8}


def test_empty_table(spark):
    assert sharding.shard_rows(documents(spark, []), 24).collect() == []
