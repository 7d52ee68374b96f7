"""Helpers of the query catalogue: table access, and DuckDB text for the oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from termloom.plans.staging import staging_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared staging folder."""
    return f"{staging_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({sql_strip(x)}, '{_SPACE}', ' ', 'g')"


def sql_words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def sql_ngrams(words: str) -> str:
    """Unigrams and bigrams of a list column."""
    return (
        f"list_concat({words}, list_transform(range(1, len({words})::BIGINT), "
        f"lambda i: {words}[i] || ' ' || {words}[i + 1]))"
    )


def sql_chars(x: str) -> str:
    """Character grams of a text, word by word."""
    return (
        f"flatten(list_transform(string_split({sql_collapse(f'lower({x})')}, ' '), lambda w: "
        "flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(w) + 4 - n), "
        "lambda i: substring(' ' || w || ' ', i, n))))))"
    )
