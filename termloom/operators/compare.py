"""Response audit and agreement between runs."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.text import strip_fence
from termloom.operators.responses import plain_list_size
from termloom.operators.summary import join_groups
from termloom.plans.staging import shuffle_width, write_stage

AUDIT_TAIL_CHARS = 100


def occurrence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "occurrence") -> DataFrame:
    """Running number within ``keys`` without gathering a key in one task.

    A key that holds most rows is numbered in range-partitioned pieces whose starts come from
    one count per piece. Null keys are keys like others.
    """
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order)
    ranged = write_stage(ranged.withColumn("__part", F.spark_partition_id()), "occurrences")
    within = Window.partitionBy(*keys, "__part").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "__part")
        .count()
        .select(*keys, "__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start"))
    )
    numbered = ranged.withColumn("__within", F.row_number().over(within))
    found = join_groups(numbered, starts, [*keys, "__part"])
    return found.select(*df.columns, (F.col("__start") + F.col("__within")).alias(name))


# What matters for the nesting of JSON: strings as a whole, or up to the end of a text that is cut off, and brackets.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}\[\]]', re.DOTALL)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _complete_objects(text: str | None, member: str) -> int:
    """How many objects in a row are whole and valid where the list ``member`` begins; commas are optional.

    One pass over the marks: the depth says where an object ends, and the next one goes on from there.
    """
    opened = re.search(rf'"{re.escape(member)}"\s*:\s*\[', text or "")
    count = depth = begin = 0
    end = opened.end() if opened else 0
    for mark in _MARKS.finditer(text, end) if opened else ():
        if depth == 0:
            if mark[0] != "{" or text[end : mark.start()].strip(" \r\n\t,"):
                break
            begin = mark.start()
        depth += _STEP.get(mark[0], 0)
        if depth == 0:
            end = mark.end()
            try:
                json.loads(text[begin:end])
            except (ValueError, RecursionError):
                break
            count += 1
    return count


@F.pandas_udf(T.IntegerType())
def complete_partial_objects(text: pd.Series, member: pd.Series) -> pd.Series:
    """Number of whole objects at the start of a list that may be cut off."""
    return pd.Series([_complete_objects(t, m) for t, m in zip(text, member)], dtype="int32")


def closing_present(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)\]\s*\}\s*\z"))


def audit_response(responses: DataFrame) -> DataFrame:
    """Audit columns for ``pass`` (``extraction`` or ``grounding``), ``text``, ``finish_reason``."""
    member = F.when(F.col("pass") == "extraction", "concepts").otherwise("annotations")
    cleaned = responses.withColumn("__clean", strip_fence(F.col("text"))).withColumn("__member", member)
    shaped = cleaned.withColumn("__shape", plain_list_size(F.col("__clean"), F.col("__member")))
    shape = F.col("__shape")
    partial = complete_partial_objects(F.col("__clean"), F.col("__member"))
    return shaped.select(
        *responses.columns,
        shape["json_valid"].alias("json_valid"),
        (F.coalesce("finish_reason", F.lit("")) == "length").alias("truncated"),
        shape["size"].alias("parsed_items"),
        partial.alias("complete_partial_objects"),
        closing_present(F.col("__clean")).alias("closing_present"),
        F.right(F.col("__clean"), F.lit(AUDIT_TAIL_CHARS)).alias("response_tail"),
    )


def audit_summary(audited: DataFrame, group: Sequence[str] = ("pass",)) -> DataFrame:
    return audited.groupBy(*group).agg(
        F.count("*").alias("responses"),
        F.count_if("json_valid").alias("valid_json"),
        F.avg(F.col("truncated").cast("int")).alias("truncation_rate"),
        F.count_if("closing_present").alias("closing_delimiters"),
    )


def partial_object_histogram(audited: DataFrame, group: Sequence[str] = ("pass",)) -> DataFrame:
    return audited.groupBy(*group, "complete_partial_objects").agg(F.count("*").alias("responses"))


# ---------------------------------------------------------------- agreement


def signatures(annotations: DataFrame, concept_counts: DataFrame, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """(keys, concept_index, status, ontology_id) for every expected concept index.

    An index without an annotation is ``missing``. A record without concepts is one row of index -1
    and status ``none``, so that comparisons still see the record.
    """
    last = (F.col("n_concepts") - 1).cast("int")
    indexes = F.when(F.col("n_concepts") > 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(-1)))
    expected = concept_counts.select(*keys, F.explode(indexes).alias("concept_index"))
    found = annotations.select(*keys, "concept_index", "status", "ontology_id")
    return expected.join(found, [*keys, "concept_index"], "left").withColumn(
        "status", F.when(F.col("concept_index") < 0, "none").otherwise(F.coalesce("status", F.lit("missing")))
    )


def _paired(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    left = a.select(*keys, F.struct("status", "ontology_id").alias("__a"))
    right = b.select(*keys, F.struct("status", "ontology_id").alias("__b"))
    return left.join(right, list(keys), how).withColumn("__same", F.col("__a").eqNullSafe(F.col("__b")))


def agreement(a: DataFrame, b: DataFrame, group: Sequence[str] = (), keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Agreement of two signature tables over records that are whole on both sides."""
    return _agreement(_paired(a, b, [*group, *keys, "concept_index"], "inner"), group, keys)


def _agreement(pairs: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    missing = (F.col("__a.status") == "missing") | (F.col("__b.status") == "missing")
    records = pairs.groupBy(*group, *keys).agg(
        F.bool_or(missing).alias("missing"),
        F.bool_and("__same").alias("exact"),
        F.count_if(F.col("__same") & (F.col("concept_index") >= 0)).alias("equal"),
        F.count_if(F.col("concept_index") >= 0).alias("compared"),
    )
    totals = records.filter(~F.col("missing")).groupBy(*group).agg(
        F.count("*").alias("comparable_records"),
        F.count_if("exact").alias("exact_records"),
        F.coalesce(F.sum("equal"), F.lit(0)).alias("equal_concepts"),
        F.coalesce(F.sum("compared"), F.lit(0)).alias("compared_concepts"),
    )
    return totals.select(
        *group,
        "comparable_records",
        F.try_divide("exact_records", "comparable_records").alias("exact_record_agreement"),
        F.try_divide("equal_concepts", "compared_concepts").alias("concept_agreement"),
        "equal_concepts",
        "compared_concepts",
    )


def variant_compare(variants: DataFrame, baseline: DataFrame, group: Sequence[str] = ("variant", "cap")) -> DataFrame:
    """Agreement of every variant with one baseline, in one job over the grouping keys."""
    on = ["rec_id", "concept_index"]
    ours = variants.select(*group, *on, F.struct("status", "ontology_id").alias("__a"))
    theirs = baseline.select(*on, F.struct("status", "ontology_id").alias("__b"))
    pairs = ours.join(theirs, on).withColumn("__same", F.col("__a").eqNullSafe(F.col("__b")))
    return _agreement(pairs, group, ["rec_id"])


def ordered_parity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Per record: are the lists of (status, id) equal in concept order?"""
    pairs = _paired(a, b, [*keys, "concept_index"], "full")
    return pairs.groupBy(*keys).agg(F.bool_and("__same").alias("parity"))


def multiset_parity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Per record: are the bags of (status, id) equal whatever the order?

    Both sides are counted in one aggregation, so a bag never forms one row or one group.
    """
    both = a.select(*keys, "status", "ontology_id", F.lit(1).alias("__n")).unionByName(
        b.select(*keys, "status", "ontology_id", F.lit(-1).alias("__n"))
    )
    balance = both.groupBy(*keys, "status", "ontology_id").agg(F.sum("__n").alias("__balance"))
    return balance.groupBy(*keys).agg(F.bool_and(F.col("__balance") == 0).alias("parity"))


def acceptance_gate(fixed: DataFrame, end_to_end: DataFrame) -> DataFrame:
    """Rates of two parity tables and whether everything agrees."""
    def rate(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.avg(F.col("parity").cast("int")).alias(name), F.coalesce(F.bool_and("parity"), F.lit(True)).alias(f"{name}_all"))

    one = F.lit(1).alias("__one")
    a = rate(fixed, "fixed_agreement").select("*", one)
    b = rate(end_to_end, "end_to_end_agreement").select("*", one)
    return a.join(b, "__one").select(
        "fixed_agreement",
        "end_to_end_agreement",
        (F.col("fixed_agreement_all") & F.col("end_to_end_agreement_all")).alias("acceptance_passed"),
    )


def acceptance_records(fixed: DataFrame, end_to_end: DataFrame, extracted: DataFrame, reference: DataFrame) -> DataFrame:
    """The lists behind the gate, one row per record of either side.

    (rec_id, fixed_parity, end_to_end_parity, extracted_concepts, reference_concepts); ``extracted`` and ``reference``
    have one row per concept, and a record without any has 0. A record that a parity table lacks has null there.
    """
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("rec_id").agg(F.count("*").alias(name))

    parities = fixed.select("rec_id", F.col("parity").alias("fixed_parity")).join(
        end_to_end.select("rec_id", F.col("parity").alias("end_to_end_parity")), "rec_id", "full"
    )
    joined = parities.join(counts(extracted, "extracted_concepts"), "rec_id", "full").join(
        counts(reference, "reference_concepts"), "rec_id", "full"
    )
    return joined.na.fill(0, ["extracted_concepts", "reference_concepts"])


def complete_records(annotations: DataFrame, concept_counts: DataFrame) -> DataFrame:
    """(rec_id, complete): do the annotation indexes cover every concept?"""
    found = concept_counts.join(annotations.select("rec_id", "concept_index").distinct(), "rec_id", "left")
    asked = (F.col("concept_index") >= 0) & (F.col("concept_index") < F.col("n_concepts"))
    return found.groupBy("rec_id", "n_concepts").agg(F.count_if(asked).alias("covered")).select(
        "rec_id", (F.col("covered") == F.col("n_concepts")).alias("complete")
    )


def rejected_ids(annotations: DataFrame) -> DataFrame:
    return annotations.agg(
        F.count_if(F.contains(F.coalesce("reason", F.lit("")), F.lit("rejected by validator"))).alias("rejected_ids")
    )


def outside_candidates(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched annotations whose ID is not among their own candidates; expected to be empty."""
    own = candidates.select("rec_id", "concept_index", F.col("id").alias("ontology_id"))
    return annotations.filter(F.col("status") == "matched").join(
        own, ["rec_id", "concept_index", "ontology_id"], "left_anti"
    )
