"""Registered queries of the operators: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.llm.alignment import alignment
from tenurekit.llm.apportion import mix
from tenurekit.llm.chaining import repeated_passages
from tenurekit.llm.dom_boosting import main_texts
from tenurekit.llm.hilbert import shard_numbers
from tenurekit.llm.hmm import scored
from tenurekit.llm.jaccard_join import jaccard_components
from tenurekit.llm.license_scan import license_scan
from tenurekit.llm.line_frequency import judged
from tenurekit.llm.prefix_trie import prefix_trie
from tenurekit.llm.token_counts import token_counts
from tenurekit.llm.url_terms import judged_urls
from tenurekit.llm.winnowing import contamination


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, up to small differences."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document."""
    return scored(_table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return judged(_table(spark, sf_dir, "documents")).drop("n_left")


def op5_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(_table(spark, sf_dir, "pages"))


def op6_two_tier(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts of every document. tokenizer: the JSON file, by default that of the installed public vocabularies."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = token_counts(_table(spark, sf_dir, "documents"), Path(tokenizer).read_text())
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_url_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judged_urls(_table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 0.8 Jaccard similarity of 5-word shingles."""
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    found = shard_numbers(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("rules", "starts", "lengths")


def op12_alignment(spark: SparkSession, sf_dir: str, first: str | None = None, second: str | None = None) -> DataFrame:
    """Links between two tokenizers' tokens in every document. first, second: a byte-level BPE's JSON and a SentencePiece model."""
    if first is None or second is None:
        import public_tokenizers

        first, second = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    return alignment(_table(spark, sf_dir, "documents"), Path(first).read_text(), Path(second).read_bytes())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chaining, op2_hmm, op3_winnowing, op4_line_frequency, op5_dom_boosting, op6_two_tier, op7_url_terms, op8_jaccard_join, op9_apportion, op10_hilbert,
        op11_signature_rules, op12_alignment, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}
