"""Structured Streaming forms: append results as they finish, keep a running summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from termloom.operators.compare import audit_response
from termloom.operators.index import TermIndex
from termloom.operators.summary import record_rollup, run_summary
from termloom.plans.enrich import Ask, enrich_to
from termloom.plans.staging import stage_run


def stream_enrich(
    records: DataFrame, index: TermIndex, ask: Ask, output: str, checkpoint: str, k: int = 5, model: str | None = None
) -> DataStreamWriter:
    """Enrich each micro-batch and append its results below ``output``.

    A batch writes its own folder and replaces it when it is run again after a failure, so
    every record is stored exactly once. Its stage tables go with it; those of a killed batch go when it is run again.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # several stages read the batch
        try:
            enrich_to(batch, index, ask, f"{output.rstrip('/')}/batch={batch_id}", k, model)
        finally:
            batch.unpersist()

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)


def stream_summary(results: DataFrame, checkpoint: str, publish: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Hand the summary over all results so far to ``publish`` after every micro-batch."""

    def save(summary: DataFrame, _: int) -> None:
        publish(summary.withColumn("run_status", F.lit("running")))

    return (
        record_rollup(results)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )


def summary_rows(results: DataFrame) -> DataFrame:
    """What a summary needs of results: states, counts and numbers, without texts, metadata and candidates."""
    stages = ("extraction", "grounding")
    numbers = ("attempted", "prompt_tokens", "generated_tokens", "wall_seconds", "finish_reason", "truncated", "json_valid", "schema_valid")

    def stage(name: str) -> Column:
        error = F.when(F.col(f"diagnostics.{name}.model_error").isNotNull(), "error").alias("model_error")
        return F.struct(*[F.col(f"diagnostics.{name}.{n}").alias(n) for n in numbers], error).alias(name)

    seconds = [F.col(f"diagnostics.{n}").alias(n) for n in ("retrieval_seconds", "record_wall_seconds")]
    statuses = F.transform("concepts", lambda c: F.struct(F.struct(c["annotation"]["status"].alias("status")).alias("annotation")))
    return results.select(
        "rec_id", "status", "failed_stage", statuses.alias("concepts"), F.struct(*[stage(s) for s in stages], *seconds).alias("diagnostics")
    )


def stream_run_summary(
    results: DataFrame, state: str, checkpoint: str, publish: Callable[[DataFrame], None], provenance: DataFrame | None = None
) -> DataStreamWriter:
    """Hand the whole ``run_summary`` over all results so far to ``publish`` after every micro-batch.

    Each batch leaves the numbers of its records in a folder of its own below ``state``, which it replaces
    when it is run again after a failure, so every record counts once. Percentiles are exact, so a summary
    reads the numbers of all batches so far. ``publish`` reads the summary before it returns, as its stage tables go then.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        folder = state.rstrip("/")
        kept = summary_rows(batch)
        kept.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        # Empty files keep the schema, so the folder can be read after any batch.
        so_far = batch.sparkSession.read.schema(kept.schema).parquet(folder)
        with stage_run(batch.sparkSession, folder):
            publish(run_summary(so_far, provenance).withColumn("run_status", F.lit("running")))

    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)


def stream_audit(responses: DataFrame) -> DataFrame:
    """Audit columns on a stream of stored responses; stateless, for append mode."""
    return audit_response(responses)
