"""Corpus pipeline: quality rules, near-duplicate removal, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs`, and returns a
DataFrame that is written as Parquet and read back as the next stage's `docs`.  All
stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingscape.llm import minhash, packing, quality, substring
from pingscape.llm.storage import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    judged, _, verdict = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(verdict).select(*[judged[f"`{c}`"] for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; documents without id stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier; those that lose every word go."""
    cut, found = substring.without_repeats(docs)
    lost, left = F.col(f"{found}.n_removed"), F.col(f"{found}.text")
    new = {"text": F.when(lost > 0, left).otherwise(F.col("text")), "n_chars": F.when(lost > 0, F.length(left)).otherwise(F.col("n_chars"))}
    columns = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    return cut.where((lost == 0) | (lost < F.col(f"{found}.n_words"))).select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: The learned rules and the alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
