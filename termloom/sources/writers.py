"""Sinks for samples and results. All refuse to overwrite an existing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_accessions(records: DataFrame, path: str, *order: str) -> None:
    """One accession per line in sample order; an empty line marks a missing one."""
    ordered = records.orderBy(*order) if order else records
    ordered.select(F.coalesce("accession", F.lit("")).alias("value")).write.mode("errorifexists").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls and non-ASCII text kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
