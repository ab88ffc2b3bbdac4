"""Queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingscape.llm import bitsliced, bpe, chat, embeddings, html_text, minhash, ordering, packing, periodic, prefix_trie, quality, sharding, substring, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the keep verdict of the learned decision list, per document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    df, stats, verdict = quality.judge(docs, _table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select("doc_id", *[F.col(f"{stats}.{c}").alias(c) for c in counts], quality.base_failed(stats).alias("base_failed"), verdict.alias("kept"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 4096 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact class, near-duplicate component and keep flag of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 within a label, component and keep flag of every vector."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 20-word window which also starts earlier, and the digest of the rest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    df, found = substring.without_repeats(docs)
    return df.select("doc_id", F.col(f"{found}.n_words").alias("n_words"), F.col(f"{found}.n_removed").alias("n_removed"), F.sha2(F.col(f"{found}.kept"), 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under a keyed permutation of the row numbers (law `rows`, 24 shards)."""
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: A conversation whose texts are control strings (fixed by the query's contract).
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds control strings, read back from their formatted text."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(hard)))


def _with_planted_period(docs: DataFrame) -> DataFrame:
    """The query's input: `documents` whose ids have a crc32 divisible by 10 repeat p words from word a on (fixed by its contract)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sized = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    a = (g % F.col("n")).cast("int")
    sized = sized.withColumns({"a": F.when(F.col("n") > 0, a), "g": g})
    sized = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with planted periods: their number, the longest one, digests of all and of the collapsed text."""
    found = periodic.collapse_runs(_with_planted_period(_table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    length = -F.col("best.minus")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose id is divisible by 100, among all other vectors."""
    return bitsliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def _rebuilt(turns: DataFrame) -> DataFrame:
    """The query's input: each conversation's first h turns are those of the conversation at the hundred below (fixed by its contract)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    own = ordering.running(rows, "conv_id", ["turn", "role", "text"])
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(100))
    heads = own.where((F.col("conv_id") == base) & (F.col("pos") < 5)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    given = own.select("conv_id").distinct().withColumns({"base": base, "h": h}).join(heads, "base").where("pos < h")
    return given.select("conv_id", "pos", "role", "text").unionByName(own.where(F.col("pos") >= h).select("conv_id", "pos", "role", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations, with subtree totals and the digest of what ends there."""
    turns = _table(spark, sf_dir, "conversations")
    nodes, ends = prefix_trie.prefix_trie(_rebuilt(turns), turns, turn_col="pos")
    ended = prefix_trie.end_digests(ends).withColumnsRenamed({"node": "conv_id"})
    return nodes.join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_order_minhash": op3_order_minhash,
    "op4_html_extraction": op4_html_extraction,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}
