"""Stage tables live as long as the run that made them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from termloom.catalog import answers
from termloom.operators.responses import replay
from termloom.plans.enrich import enrich, enrich_to
from termloom.plans.staging import stage_run, staging_folder, write_stage
from termloom.streaming.jobs import stream_enrich

FOLDER = "/root/testdata/sf0.001"


def staged(spark) -> set[str]:
    """Folders in the shared folder."""
    return set(os.listdir(staging_folder(spark).removeprefix("file:")))


@pytest.fixture(scope="module")
def parts(spark):
    records = write_stage(answers.part_records(spark, FOLDER).orderBy("rec_id").limit(30), "records")
    replies = write_stage(answers.part_replies(spark, FOLDER), "replies")
    return records, answers.part_index(spark, FOLDER), replay(replies)


def test_a_run_takes_its_tables_with_it(spark):
    before = staged(spark)
    with stage_run(spark) as outer:
        rows = write_stage(spark.range(5).toDF("id"), "rows")
        with stage_run(spark) as inner:
            assert write_stage(rows, "again").count() == 5 and inner != outer
        kept = write_stage(rows, "index", f"{staging_folder(spark)}/kept-{os.path.basename(outer)}")
        assert rows.count() == 5 and len(staged(spark) - before) == 2
    assert staged(spark) - before == {f"kept-{os.path.basename(outer)}"} and kept.count() == 5
    with pytest.raises(RuntimeError), stage_run(spark):
        write_stage(spark.range(5).toDF("id"), "rows")
        raise RuntimeError
    assert len(staged(spark) - before) == 1


def test_enriched_results_outlive_their_stages(spark, parts, tmp_path):
    records, index, ask = parts
    output = str(tmp_path / "results")
    want = sorted(map(str, enrich(records, index, ask, model="m").drop("diagnostics").collect()))
    before = staged(spark)
    # What a run that was killed has left.
    with stage_run(spark, output) as folder:
        pass
    spark.range(3).write.parquet(f"{folder}/extracted-left")
    assert len(staged(spark) - before) == 1
    for _ in range(2):
        done = enrich_to(records, index, ask, output, model="m")
        assert staged(spark) == before
        assert sorted(map(str, done.drop("diagnostics").collect())) == want


def test_nothing_is_left_after_ten_batches_and_a_failed_one(spark, parts, tmp_path):
    records, index, ask = parts
    source, output, checkpoint = (str(tmp_path / n) for n in ("source", "output", "checkpoint"))
    records.withColumn("part", F.pmod(F.xxhash64("rec_id"), F.lit(10))).repartition(10, "part").write.partitionBy("part").parquet(source)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    calls = []

    def failing_once(prompts):
        calls.append(1)
        if len(calls) == 2:
            write_stage(prompts, "half-done")
            raise RuntimeError("killed")
        return ask(prompts)

    before = staged(spark)
    for _ in range(2):
        query = stream_enrich(stream, index, failing_once, output, checkpoint, model="m").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as error:  # noqa: BLE001
            assert "killed" in str(error)
        assert staged(spark) == before
    found = spark.read.parquet(output)
    assert sorted(r.rec_id for r in found.collect()) == sorted(r.rec_id for r in records.collect())
    assert found.select("batch").distinct().count() >= 5
