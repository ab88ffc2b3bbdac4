import re

import corpus_pipeline
from pingscape.llm import packing, quality
from pingscape.llm.storage import saved
from pyspark.sql import functions as F

from .helpers import CLASHING, documents
from .test_minhash import brute as near_groups
from .test_packing import check
from .test_substring import brute as without_windows

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_equal_brute_force(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.schema

    kept = saved(corpus_pipeline.quality_stage(spark, docs, SF))
    assert kept.schema == columns
    judged, _, verdict = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in judged.where(verdict).select("doc_id").collect()}
    assert {d for d, _ in pairs(kept)} == want and len(want) < docs.count()

    single = saved(corpus_pipeline.near_dedup_stage(spark, kept, SF))
    assert single.schema == columns
    groups = near_groups(pairs(kept))
    assert sorted(pairs(single)) == sorted((d, t) for d, t in pairs(kept) if groups[d] == d)

    cut = saved(corpus_pipeline.substring_stage(spark, single, SF))
    assert cut.schema == columns
    before = pairs(single)
    after = dict(pairs(cut))
    for (d, t), (n, lost, left) in zip(before, without_windows(before), strict=True):
        if lost == n and n:
            assert d not in after
        else:
            assert " ".join(re.findall(r"[^\x20\x09-\x0D]+", after[d])) == left
            assert lost or after[d] == t
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0

    pieces = packing.pack(cut, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).collect()
    check(pieces, pairs(cut))
    out = corpus_pipeline.packing_stage(spark, cut, SF)
    assert out.count() == len(pieces) and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(docs.select(key).collect()) == sorted(corpus_pipeline.run(spark, SF).select(key).collect())


def test_awkward_rows_and_clashing_columns(spark):
    good = " ".join(f"word{i} text," for i in range(40)) + "."
    rows = [(None, good), (1, good), (1, good), (2, None), (3, ""), (4, good + " More text here."), (5, "a b c")]
    docs = documents(spark, rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = out
    ids = sorted(r.doc_id or 0 for r in docs.collect())
    assert 1 not in ids or ids.count(1) in (1, 2)
    assert corpus_pipeline.packing_stage(spark, docs, SF).count() >= len(ids)


def test_empty_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        assert docs.collect() == []
