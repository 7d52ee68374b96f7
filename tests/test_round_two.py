"""Cases that the test tables do not hold: null keys, empty records, long literals, halfway scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions.text import strip_text
from termloom.operators import compare, summary
from termloom.operators.retrieve import half_up
from termloom.sources.readers import read_triples


def test_occurrences_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    got = {(r.k, r.v, r.occurrence) for r in compare.occurrence_number(df, ["k"], ["v"]).collect()}
    assert got == {(None, 1, 1), (None, 2, 2), ("a", 1, 1)}


def test_percentiles_of_null_groups(spark):
    values = {None: [1.0, 2.0, 2.0, 7.5], "a": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in summary.distribution(df, "v", ["g"]).collect()}
    points = [0, 50, 90, 95, 99, 100]
    assert got == {g: pytest.approx(tuple(np.percentile(vs, points))) for g, vs in values.items()}


def test_summary_of_no_results_is_one_row(spark):
    stage = ("struct<attempted:boolean,prompt_tokens:long,generated_tokens:long,wall_seconds:double,finish_reason:string,"
             "truncated:boolean,json_valid:boolean,schema_valid:boolean,model_error:string>")
    shape = (f"rec_id string, status string, failed_stage string, concepts array<struct<annotation:struct<status:string>>>, "
             f"diagnostics struct<extraction:{stage},grounding:{stage},retrieval_seconds:double,record_wall_seconds:double>")
    row, = summary.run_summary(spark.createDataFrame([], shape)).collect()
    assert (row.processed_records, row.records_per_second, row.stages, row.failures_by_stage) == (0, None, {}, {})
    assert row.concepts_per_record["count"] == 0 and row.concepts_per_record.median is None


def test_records_without_concepts_are_compared(spark):
    counts = spark.createDataFrame([("r1", 1), ("r2", 0)], "rec_id string, n_concepts int")
    found = spark.createDataFrame([("r1", 0, "matched", "X:1")], "rec_id string, concept_index int, status string, ontology_id string")
    a = compare.signatures(found, counts)
    got = compare.agreement(a, a).first()
    assert (got.comparable_records, got.exact_record_agreement, got.compared_concepts) == (2, 1.0, 1)
    for parity in (compare.ordered_parity, compare.multiset_parity):
        assert {(r.rec_id, r.parity) for r in parity(a, a).collect()} == {("r1", True), ("r2", True)}


def test_completeness_compares_indexes(spark):
    counts = spark.createDataFrame([("r", 2), ("s", 1), ("t", 0)], "rec_id string, n_concepts int")
    found = spark.createDataFrame([("r", 0), ("r", 2), ("s", 0), ("s", 0)], "rec_id string, concept_index int")
    got = {r.rec_id: r.complete for r in compare.complete_records(found, counts).collect()}
    assert got == {"r": False, "s": True, "t": True}


def test_audit_takes_nan(spark):
    rows = [("extraction", '{"concepts":[NaN]}', "stop"), ("extraction", '{"concepts":[{"a":[1,"}"]}, {"b":2} {"c"', "length")]
    got = compare.audit_response(spark.createDataFrame(rows, "pass string, text string, finish_reason string")).collect()
    assert (got[0].json_valid, got[0].parsed_items) == (True, 1)
    assert (got[1].json_valid, got[1].complete_partial_objects) == (False, 2)


def test_rounding_is_sparks(spark):
    values = [0.12345, 0.12355, 0.5, 0.00005, 1.0, 0.99995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert half_up(np.array(values), 4).tolist() == [r[0] for r in df.select(F.round("v", 4)).collect()]


@pytest.mark.parametrize("text", ["", " a b ", " \x1c\x85a\xa0", " " * 5 + "x" + " " * 100_000 + "y\n"])
def test_strip_is_pythons(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(strip_text(F.col("t"))).first()[0] == text.strip()


def test_triples_with_long_and_escaped_literals(spark, tmp_path):
    literals = {"long": "x" * 100_000, "face": "\U0001f600 é", "quote": "a\\'b \"c\"\t\n"}
    forms = {"long": "x" * 100_000, "face": r"\U0001F600 é", "quote": r"a\\'b \"c\"\t\n"}
    path = tmp_path / "t.nt"
    path.write_text("# note\n\n" + "".join(f'<http://s/{k}> <http://p> "{v}" .\n' for k, v in forms.items()))
    assert {r.s.split("/")[-1]: r.o for r in read_triples(spark, str(path)).collect()} == literals
    path.write_text("garbage\n")
    with pytest.raises(Exception, match="Not an N-Triples statement"):
        read_triples(spark, str(path)).collect()
