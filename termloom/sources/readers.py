"""Readers of TSV, JSON lines, Parquet and N-Triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.tsv import read_tsv_records as read_tsv_records


def read_parquet_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All columns of a Parquet table; no list of known fields."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_jsonl_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object per line. A schema avoids the inference pass over the data."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


# The escapes of one letter in N-Triples.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

# One N-Triples statement: subject, predicate, then URI, blank node or literal with its suffix.
_TRIPLE = (
    r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+'
    r'(?:<([^>]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
)


def _unescape(text: Column) -> Column:
    """Decode the escapes of a literal, piece by piece; an unknown one is an error."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++"), F.lit(0))

    def decode(piece: Column) -> Column:
        code = F.lpad(F.substr(piece, F.lit(3)), 8, "0")
        decoded = F.when(piece.rlike(r"^\\[uU]."), F.decode(F.unhex(code), "UTF-32"))
        for letter, meant in _ESCAPES.items():
            decoded = decoded.when(piece == f"\\{letter}", meant)
        unknown = F.raise_error(F.concat(F.lit("Not an escape of N-Triples: "), piece)).cast("string")
        return decoded.when(F.startswith(piece, F.lit("\\")), unknown).otherwise(piece)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples files as ``(s, p, o, o_is_uri, lang)``; one statement per line, so splittable."""
    lines = spark.read.text(path).filter(~F.rlike(F.col("value"), F.lit(r"^\s*(?:#.*)?$")))
    parts = [F.regexp_extract("value", _TRIPLE, i) for i in range(1, 8)]
    fields = lines.select("value", *[p.alias(f"g{i}") for i, p in enumerate(parts, 1)])
    malformed = F.raise_error(F.concat(F.lit("Not an N-Triples statement: "), F.col("value")))
    uri_object = (F.col("g4") != "") | (F.col("g5") != "")
    return fields.select(
        F.when(F.col("g3") == "", malformed.cast("string"))
        .when(F.col("g1") != "", F.col("g1"))
        .otherwise(F.col("g2"))
        .alias("s"),
        F.col("g3").alias("p"),
        F.when(F.col("g4") != "", F.col("g4"))
        .when(F.col("g5") != "", F.col("g5"))
        .otherwise(_unescape(F.col("g6")))
        .alias("o"),
        uri_object.alias("o_is_uri"),
        F.nullif(F.col("g7"), F.lit("")).alias("lang"),
    )
