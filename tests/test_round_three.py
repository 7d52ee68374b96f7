"""First rows, samples by a threshold, and the lists behind the acceptance gate."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from termloom.catalog import reports
from termloom.operators import compare as A
from termloom.operators import sampling as P
from termloom.operators import summary as S
from termloom.sources.readers import read_tsv_records
from termloom.streaming.jobs import stream_run_summary


def test_limit_keeps_the_first_rows(spark, tmp_path):
    path = tmp_path / "rows.tsv"
    path.write_text("id\tv\n" + "".join(f"{i}\tv{i}\n" for i in range(5_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 3_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = [int(r.id) for r in read_tsv_records(spark, str(path), limit=700).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sorted(got) == list(range(700))
    made = spark.range(100).repartition(3)
    assert P.first_rows(made, 5).count() == 5 and P.first_rows(made, 500).count() == 100


@pytest.mark.parametrize("n", [0, 1, 40, 199, 1_999, 5_000])
def test_hash_sample_is_the_smallest_hashes(spark, n):
    # A third of the rows has one key.
    df = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = sorted(hashlib.md5(f"9:{r.k}".encode()).hexdigest() for r in P.hash_sample(df, n, 9, ["k"]).collect())
    want = sorted(hashlib.md5(f"9:{0 if i % 3 == 0 else i}".encode()).hexdigest() for i in range(2_000))[:n]
    assert got == want


def test_many_equal_keys_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(P, "SORTED_ROWS", 10)
    df = spark.range(1_000).select(F.lit(5).alias("k"), "id")
    assert P.hash_sample(df, 333, 1, ["k"]).count() == 333


CONCEPT = "struct<source_field:string,raw_value:string,annotation:struct<status:string,ontology_id:string>>"


def test_counts_and_mismatches_of_results(spark):
    note = lambda s, i: {"status": s, "ontology_id": i}
    rows = [
        ("a", {"isolation_source": "mud", "x": "1"}, [("isolation_source", "mud", note("matched", "X:1")), ("x", "2", note("unresolved", None))]),
        ("b", {"isolation_source": "mud"}, [("gone", "v", None), ("isolation_source", None, note("matched", "X:1"))]),
        ("c", {}, []),
        ("d", None, None),
    ]
    df = spark.createDataFrame(rows, f"rec_id string, metadata map<string,string>, concepts array<{CONCEPT}>")
    got = {(r.measure, r.value): r.n for r in S.result_counts(df).collect()}
    assert got == {("status", "matched"): 2, ("status", "unresolved"): 1, ("status", None): 1, ("ontology_id", "X:1"): 2, ("isolation_source", "mud"): 2}
    bad = {(r.rec_id, r.concept_index, r.raw_value, r.source_value) for r in S.source_value_mismatches(df).collect()}
    assert bad == {("a", 1, "2", "1"), ("b", 0, "v", None), ("b", 1, None, "mud")}


def test_acceptance_records_of_all_sides(spark):
    parity = lambda rows: spark.createDataFrame(rows, "rec_id string, parity boolean")
    concepts = lambda ids: spark.createDataFrame([(i,) for i in ids], "rec_id string")
    got = A.acceptance_records(parity([("a", True), ("b", False)]), parity([("a", True)]), concepts("aab"), concepts("ac"))
    assert {tuple(r) for r in got.collect()} == {("a", True, True, 2, 1), ("b", False, None, 1, 0), ("c", None, None, 0, 1)}


def test_running_summary_counts_a_replayed_batch_once(spark, tmp_path):
    results = reports.order_results(spark, "/root/testdata/sf0.001")
    kept = []
    halves = [results.filter("cast(rec_id as int) % 2 = 0"), results.filter("cast(rec_id as int) % 2 = 1")]

    class Stream:  # stands for a stream: calls the function that the writer is given
        def __init__(self, df):
            self.writeStream = self

        def option(self, *_):
            return self

        def foreachBatch(self, save):  # noqa: N802
            for batch_id in (0, 1, 1):
                save(halves[batch_id], batch_id)

    drawn = spark.createDataFrame([("all", 9)], "method string, population_records long")
    publish = lambda s: kept.append(reports.flat_summary(s).collect())
    stream_run_summary(Stream(results), str(tmp_path / "state"), "", publish, drawn)
    want = reports.flat_summary(S.run_summary(results, drawn)).collect()
    assert len(kept) == 3 and kept[1] == kept[2] == want and kept[0] != want
