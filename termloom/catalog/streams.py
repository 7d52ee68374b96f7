"""Streaming queries: a table is written in parts and read back as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.catalog import answers, reports
from termloom.catalog.common import scratch, table
from termloom.operators.responses import replay
from termloom.plans.staging import shuffle_width, write_stage
from termloom.streaming.jobs import stream_audit, stream_enrich, stream_run_summary, stream_summary

PARTS = 3


def _stored(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many files as ``PARTS`` batches of a shuffle's width take, so no task has a whole batch."""
    return write_stage(df.repartition(PARTS * shuffle_width(spark), key), "stream-source")


def _stream_of(stored: DataFrame) -> DataFrame:
    """The files of a stored table in ``PARTS`` batches at most."""
    spark = stored.sparkSession
    files = stored.inputFiles()
    batch = max(1, -(-len(files) // PARTS))
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", batch).parquet(files[0].rpartition("/")[0])


def _as_stream(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    return _stream_of(_stored(spark, df, key))


def audit(spark: SparkSession, d: str) -> DataFrame:
    source = _as_stream(spark, table(spark, d, "conversations"), "conv_id")
    output, checkpoint = scratch(spark, "stream-audit"), scratch(spark, "stream-checkpoint")
    audited = stream_audit(reports.audit_rows(source)).selectExpr(*reports.AUDIT_COLUMNS)
    query = audited.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output, format="parquet")
    query.awaitTermination()
    return spark.read.schema(audited.schema).parquet(output)


def enrichment(spark: SparkSession, d: str) -> DataFrame:
    records = _as_stream(spark, answers.part_records(spark, d), "rec_id")
    output, checkpoint = scratch(spark, "stream-results"), scratch(spark, "stream-checkpoint")
    writer = stream_enrich(
        records, answers.part_index(spark, d), replay(answers.part_replies(spark, d)), output, checkpoint, model="replay"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return answers.enrichment_columns(spark.read.parquet(output).drop("batch"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    results = _as_stream(spark, reports.order_results(spark, d), "rec_id")
    output, checkpoint = scratch(spark, "stream-summary"), scratch(spark, "stream-checkpoint")
    writer = stream_summary(results, checkpoint, lambda s: s.write.mode("overwrite").parquet(output))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(output)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole summary as it stands after the last of three batches."""
    results = _stored(spark, reports.order_results(spark, d), "rec_id")
    # A count of the stored rows, as every batch takes it again.
    population = results.agg(F.count("*").alias("population_records")).select(F.lit("all").alias("method"), "population_records")
    output, checkpoint, state = (scratch(spark, f"stream-run-{n}") for n in ("summary", "checkpoint", "state"))
    writer = stream_run_summary(_stream_of(results), state, checkpoint, lambda s: s.write.mode("overwrite").parquet(output), population)
    writer.trigger(availableNow=True).start().awaitTermination()
    return reports.flat_summary(spark.read.parquet(output))


QUERIES = {"stream_audit": audit, "stream_enrich": enrichment, "stream_summary": summary, "stream_run_summary": run_summary}
ORACLES = {
    "stream_audit": reports.AUDITED,
    "stream_enrich": answers.ENRICHED,
    "stream_summary": f"SELECT *, 'running' AS run_status FROM ({reports.RECORD_ROLLUP})",
    "stream_run_summary": reports.RUN_SUMMARY,
}
