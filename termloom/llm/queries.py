"""Queries of this folder over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.ann import nearest
from termloom.llm.common import table
from termloom.llm.divergence import source_divergence
from termloom.llm.jaccard_join import join_similar
from termloom.llm.license_scan import scan_licenses
from termloom.llm.line_dedup import page_report
from termloom.llm.mixing import mix_report
from termloom.llm.oracles import ORACLES as ORACLES
from termloom.llm.packing import pack
from termloom.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads
from termloom.llm.quality import quality_report
from termloom.llm.reshard import reshard
from termloom.llm.suffix_dedup import repeated_passages
from termloom.llm.toxicity import toxicity_report
from termloom.llm.training_order import training_report
from termloom.plans.staging import write_stage

OLD_SHARDS, SHARDS = 32, 40


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def reshard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards dealt by a checksum of the id to 40 of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(OLD_SHARDS))
    placed = reshard(docs, old, SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_report(table(spark, sf_dir, "pages"))


def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_report(table(spark, sf_dir, "documents"), tokenizer_path())


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False, cache_words=600_000)


def divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def trie_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that start with turns of the first conversation of their twenty."""
    turns = write_stage(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*with_shared_heads(turns))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_license_scan": license_scan,
    "op2_reshard": reshard_documents,
    "op3_quality_rules": quality_rules,
    "op4_mix_sources": mix_sources,
    "op5_suffix_dedup": suffix_dedup,
    "op6_nearest_vectors": nearest_vectors,
    "op7_line_dedup": line_dedup,
    "op8_training_order": training_order,
    "op9_jaccard_join": jaccard_join,
    "op10_pack_sequences": pack_sequences,
    "op11_source_divergence": divergence_audit,
    "op12_prefix_trie": trie_of_conversations,
    "op13_toxicity": toxicity,
}
