"""Enrichment as set-oriented stages: prompts, answers, concepts, candidates, annotations.

Every stage works on the rows that the stage before accepted and is left-joined back, so each
input record comes out exactly once. Answers of the model are written to a table as soon as
they exist: a lost executor never causes a second model call for stored answers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import fixed_values as V
from termloom.operators import prompts as P
from termloom.operators import responses as R
from termloom.operators.canonical import fields_to_metadata
from termloom.operators.index import TermIndex
from termloom.operators.retrieve import retrieve_for_concepts
from termloom.operators.sampling import first_rows
from termloom.plans.staging import stage_run, write_stage

Ask = Callable[[DataFrame], DataFrame]


def _stage_struct(prefix: str, attempted: Column, skipped: Column, accepted: Column, rebuild_error: Column) -> Column:
    def col(name: str) -> Column:
        return F.col(f"{prefix}_{name}")

    check = F.col(f"{prefix}_check")
    tested = attempted & col("model_error").isNull()
    return F.struct(
        attempted.alias("attempted"),
        skipped.alias("skipped_reason"),
        col("prompt_tokens").alias("prompt_tokens"),
        col("generated_tokens").alias("generated_tokens"),
        F.coalesce(col("wall_seconds"), F.lit(0.0)).alias("wall_seconds"),
        col("finish_reason").alias("finish_reason"),
        F.when(tested, check["truncated"]).alias("truncated"),
        F.when(tested, check["json_valid"]).alias("json_valid"),
        F.when(tested, check["schema_valid"]).alias("schema_valid"),
        col("raw_response").alias("raw_response"),
        col("model_error").alias("model_error"),
        F.when(tested, check["json_error"]).alias("json_error"),
        F.when(tested, check["schema_errors"]).otherwise(F.array().cast("array<string>")).alias("schema_errors"),
        rebuild_error.alias("reconstruction_error"),
        accepted.alias("accepted"),
    )


def _answers(ask: Ask, prompts: DataFrame, prefix: str) -> DataFrame:
    answered = write_stage(ask(prompts), f"{prefix}-answers")
    names = ["raw_response", "finish_reason", "prompt_tokens", "generated_tokens", "wall_seconds", "model_error"]
    return answered.select("rec_id", *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def extract_concepts(records: DataFrame, ask: Ask) -> DataFrame:
    """Records with the checked extraction answer and the rebuilt ``concepts``."""
    filled = F.size("metadata") > 0
    prompts = records.filter(filled).select(
        "rec_id",
        F.lit("extraction").alias("stage"),
        P.extraction_prompt().alias("prompt"),
        P.extraction_schema(F.col("metadata")).alias("response_schema"),
    )
    joined = records.join(_answers(ask, prompts, "extraction"), "rec_id", "left")
    shaped = joined.withColumn("extraction_shape", R.response_shape(F.col("extraction_raw_response"), F.lit("c")))
    shape = F.col("extraction_shape")
    errors = R.extraction_errors(shape, F.map_keys("metadata"))
    return (
        shaped.withColumn("extraction_check", R.checked(shape, errors, F.col("extraction_finish_reason")))
        .withColumn(
            "extraction_rebuild_error",
            F.when(F.col("extraction_check.accepted"), R.concepts_error(shape, F.col("metadata"))),
        )
        .withColumn(
            "concepts",
            F.when(F.col("extraction_check.accepted"), R.reconstruct_concepts(shape, F.col("metadata"))),
        )
        .drop("extraction_shape")
    )


def bundle_candidates(extracted: DataFrame, index: TermIndex, k: int) -> DataFrame:
    """(rec_id, bundles): concepts in order with their candidates."""
    concepts = extracted.select("rec_id", F.posexplode("concepts").alias("concept_index", "concept"))
    found = retrieve_for_concepts(concepts.select("rec_id", "concept_index", "concept", "concept.*"), index, k)
    bundle = F.struct("concept_index", "concept", "candidates")
    return found.groupBy("rec_id").agg(F.array_sort(F.collect_list(bundle)).alias("bundles"))


def ground_concepts(extracted: DataFrame, bundles: DataFrame, ask: Ask) -> DataFrame:
    """Extracted records with candidates, checked grounding answer and ``annotations``."""
    bundled = extracted.join(bundles, "rec_id", "left")
    prompts = bundled.filter(F.size("bundles") > 0).select(
        "rec_id",
        F.lit("grounding").alias("stage"),
        P.grounding_prompt(F.col("metadata"), F.col("bundles")).alias("prompt"),
        P.grounding_schema(F.col("bundles")).alias("response_schema"),
    )
    joined = bundled.join(_answers(ask, prompts, "grounding"), "rec_id", "left")
    shaped = joined.withColumn("grounding_shape", R.response_shape(F.col("grounding_raw_response"), F.lit("s")))
    shape = F.col("grounding_shape")
    counts = F.transform("bundles", lambda b: F.size(b["candidates"]))
    errors = R.grounding_errors(shape, counts)
    return (
        shaped.withColumn("grounding_check", R.checked(shape, errors, F.col("grounding_finish_reason")))
        .withColumn(
            "grounding_rebuild_error",
            F.when(F.col("grounding_check.accepted"), R.annotations_error(shape, F.col("bundles"))),
        )
        .withColumn(
            "annotations",
            F.when(F.col("grounding_check.accepted"), R.reconstruct_annotations(shape, F.col("bundles"))),
        )
        .drop("grounding_shape")
    )


def enrich(records: DataFrame, index: TermIndex, ask: Ask, k: int = 5, model: str | None = None) -> DataFrame:
    """Enrichment results of ``records`` (unique ``rec_id`` string, accession, metadata).

    The stage tables stay until the results are read; ``enrich_to``, or a ``stage_run`` around the call, removes them.
    """
    extracted = write_stage(extract_concepts(records, ask), "extracted")
    bundles = write_stage(bundle_candidates(extracted, index, k), "bundles")
    return assemble_results(ground_concepts(extracted, bundles, ask), model)


def enrich_to(
    records: DataFrame, index: TermIndex, ask: Ask, output: str, k: int = 5, model: str | None = None
) -> DataFrame:
    """Write the enrichment results of ``records`` to the Parquet folder ``output`` and read them back.

    What is there is replaced. The stage tables are removed, as are those of a killed run to the same folder.
    """
    spark = records.sparkSession
    with stage_run(spark, output):
        results = enrich(records, index, ask, k, model)
        results.write.mode("overwrite").parquet(output)
    return spark.read.schema(results.schema).parquet(output)


def assemble_results(grounded: DataFrame, model: str | None = None) -> DataFrame:
    """Status, failed stage, error and diagnostics of every record."""
    empty = F.size("metadata") == 0
    extraction_ok = F.col("concepts").isNotNull()
    no_concepts = extraction_ok & (F.size("concepts") == 0)
    asked_grounding = F.coalesce(F.size("bundles") > 0, F.lit(False))
    grounding_ok = F.col("annotations").isNotNull()
    completed = no_concepts | grounding_ok
    failed_stage = F.when(~extraction_ok, "concept_extraction").when(~completed, "grounding")

    def failure(prefix: str) -> Column:
        rebuild = F.col(f"{prefix}_rebuild_error")
        return (
            F.when(F.col(f"{prefix}_model_error").isNotNull(), "StageFailure: Model call failed")
            .when(rebuild.isNotNull(), F.concat(F.lit("ValueError: "), rebuild))
            .otherwise(f"StageFailure: {V.REFUSED_OUTPUT}")
        )

    error = (
        F.when(empty, V.SKIP_EMPTY_METADATA)
        .when(~extraction_ok, failure("extraction"))
        .when(~completed, failure("grounding"))
    )
    grounding_skipped = (
        F.when(empty, V.SKIP_NO_EXTRACTION)
        .when(~extraction_ok, f"{V.SKIP_PREVIOUS_STAGE}concept_extraction")
        .when(no_concepts, V.SKIP_NO_CONCEPTS)
    )
    diagnostics = F.struct(
        _stage_struct(
            "extraction", ~empty, F.when(empty, V.SKIP_EMPTY_METADATA), extraction_ok, F.col("extraction_rebuild_error")
        ).alias("extraction"),
        _stage_struct(
            "grounding", asked_grounding, grounding_skipped, grounding_ok, F.col("grounding_rebuild_error")
        ).alias("grounding"),
        F.lit(0.0).alias("retrieval_seconds"),
        (
            F.coalesce("extraction_wall_seconds", F.lit(0.0)) + F.coalesce("grounding_wall_seconds", F.lit(0.0))
        ).alias("record_wall_seconds"),
    )
    concepts = F.transform(
        F.coalesce("bundles", F.array().cast(grounded.schema["bundles"].dataType)),
        lambda b, i: F.struct(
            *[b["concept"][n].alias(n) for n in
              ("concept_type", "source_field", "raw_value", "normalized_query", "evidence")],
            b["candidates"].alias("candidates"),
            F.get("annotations", i).alias("annotation"),
        ),
    )
    return grounded.select(
        "rec_id",
        "accession",
        "metadata",
        concepts.alias("concepts"),
        F.lit(model).cast("string").alias("model"),
        F.when(completed, "completed").otherwise("failed").alias("status"),
        failed_stage.alias("failed_stage"),
        error.alias("error"),
        diagnostics.alias("diagnostics"),
        F.struct(
            F.col("extraction_raw_response").alias("extraction_raw"),
            F.when(no_concepts, '{"s":[]}').otherwise(F.col("grounding_raw_response")).alias("grounding_raw"),
        ).alias("debug"),
    )


def annotate(results: DataFrame, include_candidates: bool = False, debug: bool = False) -> DataFrame:
    """Verbose output rows of enrichment results; a failed record fails the job.

    A concept without an annotation is reported as unresolved.
    """
    unanswered = F.struct(
        F.lit(None).cast("int").alias("concept_index"),
        F.lit("unresolved").alias("status"),
        F.lit(None).cast("string").alias("ontology_id"),
        F.lit(None).cast("string").alias("label"),
        F.lit(V.REASON_NO_RESPONSE).alias("reason"),
        F.lit(None).cast("double").alias("retrieval_score"),
    )
    names = ["concept_type", "source_field", "raw_value", "normalized_query", "evidence"]
    names += ["candidates"] if include_candidates else []
    concepts = F.transform(
        "concepts",
        lambda c: F.struct(
            *[c[n].alias(n) for n in names], F.coalesce(c["annotation"], unanswered).alias("annotation")
        ),
    )
    stop = F.raise_error(F.concat(F.lit("Record "), F.col("rec_id"), F.lit(" failed: "), F.col("error")))
    return results.select(
        "rec_id",
        F.when(F.col("status") == "failed", stop.cast(results.schema["metadata"].dataType))
        .otherwise(F.col("metadata"))
        .alias("metadata"),
        concepts.alias("concepts"),
        "model",
        *(["debug"] if debug else []),
    )


def annotate_table(
    df: DataFrame,
    index: TermIndex,
    ask: Ask,
    id_column: str,
    fields: Sequence[str] | None = None,
    limit: int = 0,
    k: int = 5,
    model: str | None = None,
    include_candidates: bool = False,
    debug: bool = False,
) -> DataFrame:
    """Annotate the rows of an all-text table, using only ``fields``; ``limit`` keeps the first rows, 0 means all."""
    # The kept rows are fixed before several stages read them.
    chosen = write_stage(first_rows(df, limit), "limited") if limit else df
    names = list(fields) if fields else [c for c in df.columns if c != id_column]
    records = fields_to_metadata(chosen, names, keep=[id_column]).select(
        F.col(id_column).cast("string").alias("rec_id"), F.lit(None).cast("string").alias("accession"), "metadata"
    )
    return annotate(enrich(records, index, ask, k, model), include_candidates, debug)
