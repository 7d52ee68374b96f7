"""Response checks, reconstruction, enrichment flow and summaries."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import fixed_values as V
from termloom.operators import compare as A
from termloom.operators import index as I
from termloom.operators import prompts as P
from termloom.operators import responses as R
from termloom.operators import summary as S
from termloom.operators.ontology import TERM_SCHEMA, number_terms
from termloom.plans.enrich import annotate, enrich

HIT = "struct<rank:int,score:double,id:string,label:string,synonyms:array<string>,definition:string,parents:array<string>,iri:string>"
BUNDLES = f"array<struct<concept_index:int,concept:struct<source_field:string>,candidates:array<{HIT}>>>"
GRANITE = (1, 1.5, "ROCK:412", "Granitum album", ["granite"], "A pale\n stone.", [], "t/1")


@pytest.mark.parametrize(
    ("raw", "finish", "want"),
    [
        ('{"c":[]}', "stop", (True, True, True, False)),
        ('{"c":[]}', "length", (True, True, False, True)),
        ('{"c":[]}', "abort", (True, True, False, False)),
        ('{"c":[', "stop", (False, None, False, False)),
        ('```json\n{"c":[]}\n```', "stop", (False, None, False, False)),
        ('{"c":NaN}', "stop", (False, None, False, False)),
        ('{"wrong":[]}', "stop", (True, False, False, False)),
        ('{"c":[]} trailing', "stop", (False, None, False, False)),
        ('{"c":[],"c":[]}', "stop", (True, True, True, False)),
        ('[1]', "stop", (True, False, False, False)),
        ('{"c":[["outcrop","x","y"]]}', "stop", (True, True, True, False)),
        ('{"c":[["unknown","x","y"]]}', "stop", (True, False, False, False)),
        ('{"c":[["outcrop","","y"]]}', "stop", (True, False, False, False)),
        ('{"c":[["outcrop","x",1]]}', "stop", (True, False, False, False)),
    ],
)
def test_extraction_check(spark, raw, finish, want):
    df = spark.createDataFrame([("extraction", raw, finish, ["outcrop"], [])],
                               "stage string, raw_response string, finish_reason string, fields array<string>, candidate_counts array<int>")
    row = R.check_responses(df).first()
    assert (row.json_valid, row.schema_valid, row.accepted, row.truncated) == want
    assert bool(row.schema_errors) == (row.schema_valid is False) and (row.json_error is None) == row.json_valid


def test_selections(spark):
    cases = ['{"s":[0]}', '{"s":[null]}', '{"s":[-1]}', '{"s":[1]}', '{"s":[4]}', '{"s":[true]}', '{"s":[0.0]}',
             '{"s":["ROCK:412"]}', '{"s":[]}', '{"t":[0]}']
    df = spark.createDataFrame([(raw, [(0, ("outcrop",), [GRANITE])]) for raw in cases], f"raw string, bundles {BUNDLES}")
    shaped = df.withColumn("shape", R.response_shape(F.col("raw"), F.lit("s")))
    rows = shaped.select("raw", R.reconstruct_annotations(F.col("shape"), F.col("bundles")).alias("a"),
                         R.annotations_error(F.col("shape"), F.col("bundles")).alias("error"),
                         R.grounding_errors(F.col("shape"), F.array(F.lit(1))).alias("errors")).collect()
    found = {r.raw: r for r in rows}
    first = found['{"s":[0]}'].a[0]
    assert (first.status, first.ontology_id, first.label, first.retrieval_score) == ("matched", "ROCK:412", "Granitum album", 1.5)
    assert found['{"s":[null]}'].a[0].reason == V.REASON_NOT_SELECTED
    for raw in cases[2:8]:
        assert found[raw].a[0].status == "unresolved" and found[raw].a[0].ontology_id is None
        assert found[raw].a[0].reason == V.REASON_BAD_INDEX
    for raw in cases[8:]:
        assert found[raw].a is None and found[raw].error
    # Zero written as 0.0 equals an allowed choice in the schema, but does not select.
    assert [r.raw for r in rows if not r.errors] == cases[:2] + ['{"s":[0.0]}']


def test_prompt_has_one_short_definition_and_no_ids(spark):
    hits = [GRANITE[:5] + ("", [], "t/0"), GRANITE, GRANITE] + [GRANITE] * 4
    df = spark.createDataFrame([({"outcrop": "granite", "x": " n/a "}, [(0, ("outcrop",), hits)])], f"metadata map<string,string>, bundles {BUNDLES}")
    text = df.select(P.grounding_prompt(F.col("metadata"), F.col("bundles"))).first()[0]
    head, payload = text.split(V.GROUNDING_PROMPT_MIDDLE)
    assert head == "Original metadata:\noutcrop=granite" and "ROCK" not in payload
    candidates = json.loads(payload)[0]["candidates"]
    assert [c["index"] for c in candidates] == [0, 1, 2, 3, 4]
    assert [c.get("definition") for c in candidates] == [None, "A pale stone.", None, None, None]
    schema = df.select(P.grounding_schema(F.col("bundles"))).first()[0]
    assert json.loads(schema)["properties"]["s"]["prefixItems"] == [{"enum": [None, "0", "1", "2", "3", "4"]}] or (
        json.loads(schema)["properties"]["s"]["prefixItems"] == [{"enum": [None, 0, 1, 2, 3, 4]}])


RECORDS = [
    ("good", {"outcrop": "granite", "novel": "x"}), ("none", {"outcrop": "granite"}), ("empty", {}), ("cut", {"outcrop": "granite"}),
    ("bad_index", {"outcrop": "granite"}), ("unknown", {"outcrop": "granite"}), ("blank", {"outcrop": "granite"}), ("silent", {"outcrop": "granite"}),
]
ANSWERS = {
    "good": ('{"c":[["outcrop","rock type","white granite"]]}', "stop", '{"s":[0]}'),
    "none": ('{"c":[]}', "stop", None),
    "cut": ('{"c":[]}', "length", None),
    "bad_index": ('{"c":[["outcrop","rock type","granite"]]}', "stop", '{"s":[8]}'),
    "unknown": ('{"c":[["nope","rock type","granite"]]}', "stop", None),
    "blank": ('{"c":[["outcrop"," ","granite"]]}', "stop", None),
}


@pytest.fixture(scope="module")
def results(spark):
    terms = spark.createDataFrame([("ROCK:412", "t/1", "Granitum album", ["granite", "white granite"], "", []),
                                   ("ROCK:7", "t/2", "Basaltum nigrum", ["basalt"], "", [])], TERM_SCHEMA)
    index = I.build_index(number_terms(terms))
    replies = [(k, "extraction", a, f, 10, 5, 2.0) for k, (a, f, _) in ANSWERS.items()]
    replies += [(k, "grounding", g, "stop", 10, 5, 3.0) for k, (_, _, g) in ANSWERS.items() if g]
    stored = spark.createDataFrame(replies, "rec_id string, stage string, raw_response string, finish_reason string, "
                                            "prompt_tokens long, generated_tokens long, wall_seconds double")
    records = spark.createDataFrame([(k, k.upper(), m) for k, m in RECORDS], "rec_id string, accession string, metadata map<string,string>")
    return enrich(records, index, R.replay(stored), model="offline").persist()


def test_enrichment_flow(results):
    rows = {r.rec_id: r for r in results.collect()}
    assert len(rows) == len(RECORDS)
    good = rows["good"]
    concept = good.concepts[0]
    assert (good.status, concept.raw_value, concept.evidence, concept.annotation.ontology_id) == (
        "completed", "granite", "outcrop=granite", "ROCK:412")
    assert good.diagnostics.extraction.accepted and good.diagnostics.grounding.accepted
    assert good.metadata == {"outcrop": "granite", "novel": "x"} and good.diagnostics.record_wall_seconds == 5.0
    assert rows["none"].status == "completed" and not rows["none"].diagnostics.grounding.attempted
    assert rows["none"].debug.grounding_raw == '{"s":[]}'
    assert rows["empty"].error == V.SKIP_EMPTY_METADATA and not rows["empty"].diagnostics.extraction.attempted
    for name in ("cut", "unknown", "blank", "silent"):
        assert rows[name].failed_stage == "concept_extraction" and not rows[name].diagnostics.grounding.attempted
        assert rows[name].concepts == []
    assert rows["cut"].diagnostics.extraction.truncated and rows["cut"].diagnostics.extraction.schema_valid
    assert rows["blank"].diagnostics.extraction.reconstruction_error and rows["blank"].diagnostics.extraction.schema_valid
    assert "no stored response" in rows["silent"].diagnostics.extraction.model_error
    assert rows["silent"].diagnostics.extraction.json_valid is None
    bad = rows["bad_index"]
    assert bad.failed_stage == "grounding" and bad.concepts[0].candidates and bad.concepts[0].annotation is None
    assert bad.diagnostics.grounding.schema_valid is False


def test_annotate_stops_at_a_failed_record(results):
    assert annotate(results.filter("status = 'completed'")).count() == 2
    with pytest.raises(Exception, match="failed"):
        annotate(results).collect()


def test_summary(results, spark):
    total = S.record_rollup(results).first()
    assert (total.processed_records, total.completed_records, total.failed_records) == (8, 2, 6)
    assert (total.total_concepts, total.matched_annotations, total.concepts_without_annotations) == (2, 1, 1)
    stages = {r.stage: r for r in S.stage_rollup(S.stage_rows(results)).collect()}
    extraction = stages["extraction"]
    assert (extraction.attempted_records, extraction.skipped_records, extraction.model_errors) == (7, 1, 1)
    assert extraction.truncation_rate == 1 / 7 and extraction.schema_failures == 1 and extraction.json_evaluated_records == 6
    assert stages["grounding"].attempted_records == 2 and stages["grounding"].generated_tokens_total == 10
    nothing = S.stage_rollup(S.stage_rows(results.filter("rec_id = 'empty'")))
    assert all(r.truncation_rate is None for r in nothing.collect())
    assert {r.failed_stage: r.records for r in S.failures_by_stage(results).collect()} == {"concept_extraction": 5, "grounding": 1}


def test_statistics(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", None)] + [("c", float(i % 50)) for i in range(333)], "g string, v double")
    direct = {r.g: r for r in S.numeric_statistics(df, "v", ["g"]).collect()}
    assert direct["a"].median == 5 and direct["a"].p99 == pytest.approx(9.9)
    assert direct["b"]["count"] == 0 and direct["b"].total == 0 and direct["b"].median is None
    values = [float(i % 50) for i in range(333)]
    assert [direct["c"][n] for n in S.STATISTIC_NAMES] == pytest.approx([np.quantile(values, q) for q in S.STATISTIC_POINTS])
    empty = S.numeric_statistics(df.filter("false"), "v").first()
    assert (empty["count"], empty.total, empty.mean, empty.max) == (0, 0, None, None)
    assert S.numeric_statistics(df, "v").first().median == pytest.approx(np.median([0.0, 10.0, *values]))
    caps = spark.createDataFrame([(90.0,), (20.0,)], "p double").select(S.token_cap_suggestion(F.col("p")).alias("c"))
    assert [r.c for r in caps.collect()] == [128, 32]


def test_parity_and_partial_objects(spark):
    def side(rows):
        return spark.createDataFrame(rows, "rec_id string, concept_index int, status string, ontology_id string")
    a = side([("r", 0, "matched", "X"), ("r", 1, "unresolved", None), ("q", 0, "matched", "X")])
    b = side([("r", 0, "unresolved", None), ("r", 1, "matched", "X"), ("q", 0, "matched", "X"), ("q", 1, "matched", "X")])
    assert {r.rec_id: r.parity for r in A.ordered_parity(a, b).collect()} == {"r": False, "q": False}
    assert {r.rec_id: r.parity for r in A.multiset_parity(a, b).collect()} == {"r": True, "q": False}
    texts = spark.createDataFrame([("extraction", '```json\n{"concepts": [{"a": "]"}, {"b": {}}, {"c"', "length")], "pass string, text string, finish_reason string")
    row = A.audit_response(texts).first()
    assert (row.json_valid, row.complete_partial_objects, row.closing_present, row.truncated) == (False, 2, False, True)


class Flaky:
    def respond(self, stage, prompts):
        if any("bad" in p["prompt"] for p in prompts):
            raise RuntimeError("out of context")
        return [{"text": "ok", "finish_reason": "stop", "generated_tokens": 1} for _ in prompts]


def test_one_bad_prompt_does_not_fail_its_batch(spark):
    prompts = spark.createDataFrame([(str(i), "extraction", "bad" if i == 3 else "fine", "{}") for i in range(9)],
                                    "rec_id string, stage string, prompt string, response_schema string")
    rows = {r.rec_id: r for r in R.respond_with(Flaky, batch=4)(prompts).collect()}
    assert [k for k, r in rows.items() if r.model_error] == ["3"] and "out of context" in rows["3"].model_error
    assert all(r.raw_response == "ok" for k, r in rows.items() if k != "3")
