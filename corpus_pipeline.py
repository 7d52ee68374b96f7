"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import table
from termloom.llm.jaccard_join import keep_one_of_each
from termloom.llm.line_dedup import drop_lines_of_documents
from termloom.llm.mixing import mixed_documents
from termloom.llm.packing import pack
from termloom.llm.quality import filter_quality
from termloom.llm.queries import tokenizer_path
from termloom.plans.staging import write_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fences of their language and source."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many documents of their source share."""
    return drop_lines_of_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with their ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packed", packed),
]

# Near-copy classes rest on a tokenizer's and a hash's output further down, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
