"""Ontology terms from triples ``(s, p, o, o_is_uri)``; blank nodes start with ``_:``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.fixed_values import (
    DEFINITION,
    EDITOR_LABEL,
    OWL_CLASS,
    RDF_TYPE,
    RDFS_LABEL,
    RDFS_SUBCLASS_OF,
    SYNONYM_PREDICATES,
)
from termloom.functions.text import blank_to_null, compact_id
from termloom.operators.sampling import dense_number

TERM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("iri", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("definition", T.StringType()),
        T.StructField("parents", T.ArrayType(T.StringType())),
    ]
)


def _is_uri_subject() -> Column:
    return ~F.startswith(F.col("s"), F.lit("_:"))


def labelled_subjects(triples: DataFrame) -> DataFrame:
    """URI subjects that are classes or carry a label, once each."""
    is_class = (F.col("p") == RDF_TYPE) & (F.col("o") == OWL_CLASS) & F.col("o_is_uri")
    return (
        triples.filter(_is_uri_subject() & (is_class | (F.col("p") == RDFS_LABEL)))
        .select(F.col("s").alias("iri"))
        .distinct()
    )


def terms_from_triples(triples: DataFrame) -> DataFrame:
    """One row per labelled subject.

    All attributes come out of one aggregation over the triples, so the graph is shuffled
    once, by subject. A graph gives no order to several labels or definitions of one subject;
    the smallest text is taken.
    """
    text = blank_to_null(F.col("o"))
    used = (RDF_TYPE, RDFS_LABEL, EDITOR_LABEL, DEFINITION, RDFS_SUBCLASS_OF, *SYNONYM_PREDICATES)
    synonym_rank = F.array_position(F.array(*[F.lit(p) for p in SYNONYM_PREDICATES]), F.col("p"))
    is_class = (F.col("p") == RDF_TYPE) & (F.col("o") == OWL_CLASS) & F.col("o_is_uri")
    # Duplicate triples are removed first, which also bounds what one subject collects.
    rows = triples.filter(_is_uri_subject() & F.col("p").isin(*used)).dropDuplicates(["s", "p", "o", "o_is_uri"])
    grouped = rows.groupBy(F.col("s").alias("iri")).agg(
        F.bool_or(is_class | (F.col("p") == RDFS_LABEL)).alias("listed"),
        F.min(F.when(F.col("p") == RDFS_LABEL, text)).alias("main_label"),
        F.min(F.when(F.col("p") == EDITOR_LABEL, text)).alias("editor_label"),
        F.min(F.when(F.col("p") == DEFINITION, text)).alias("definition"),
        F.collect_list(
            F.when((synonym_rank > 0) & text.isNotNull(), F.struct(synonym_rank.alias("rank"), text.alias("text")))
        ).alias("found"),
        F.collect_set(
            F.when((F.col("p") == RDFS_SUBCLASS_OF) & F.col("o_is_uri") & ~F.startswith("o", F.lit("_:")),
                   compact_id(F.col("o")))
        ).alias("parents"),
    )
    label = F.coalesce("main_label", "editor_label")
    ordered = F.transform(F.array_sort("found"), lambda s: s["text"])
    return grouped.filter(F.col("listed") & label.isNotNull()).select(
        compact_id(F.col("iri")).alias("id"),
        "iri",
        label.alias("label"),
        F.array_except(F.array_distinct(ordered), F.array(label)).alias("synonyms"),
        F.coalesce("definition", F.lit("")).alias("definition"),
        F.array_sort("parents").alias("parents"),
    )


def number_terms(terms: DataFrame) -> DataFrame:
    """One row per IRI with its stable ordinal ``term_no`` in IRI order; written to a table."""
    numbered = dense_number(terms.dropDuplicates(["iri"]), ["iri"], "term_no", stage="terms")
    if numbered.isEmpty():
        raise ValueError("No labelled terms found")
    return numbered
