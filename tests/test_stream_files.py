"""Batches of a stream lie in many files."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import streams
from tests.session import session


def test_a_batch_of_a_stream_is_more_than_one_file():
    spark = session()
    rows = spark.range(400).select(F.col("id").cast("string").alias("rec_id"))
    stored = streams._stored(spark, rows, "rec_id")
    assert len(stored.inputFiles()) > streams.PARTS
    sizes = []
    writer = streams._stream_of(stored).writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count()))
    writer.option("checkpointLocation", streams.scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 400 and len(sizes) == streams.PARTS
