"""Queries over prompts, responses, reconstruction and enrichment.

Responses are derived from the tables, since no model is part of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.catalog.common import sql_strip, table
from termloom.functions import fixed_values as V
from termloom.operators import canonical as C
from termloom.operators import index as I
from termloom.operators import prompts as P
from termloom.operators import responses as R
from termloom.operators.ontology import number_terms
from termloom.plans import enrich as E
from termloom.plans.staging import spread


def extraction_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") > 12, "None").otherwise(F.col("c_mktsegment")).alias("segment")
    )
    records = C.fields_to_metadata(rows, ["segment", "c_name"], keep=["c_custkey"])
    return records.select("c_custkey", P.extraction_prompt().alias("prompt"))


EXTRACTION_PROMPTS = """
SELECT c_custkey, 'Metadata record:' || chr(10) ||
       concat_ws(chr(10), CASE WHEN c_nationkey <= 12 THEN 'segment=' || c_mktsegment END, 'c_name=' || c_name) AS prompt
FROM customer
"""


# ---------------------------------------------------------------- candidate payloads


def _order_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Line items of an order as its ranked candidates; an order has few lines."""
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    candidate = F.struct(
        F.col("l_quantity").alias("score"),
        F.col("l_partkey").alias("partkey"),
        F.concat(F.lit("PART:"), F.col("l_partkey")).alias("id"),
        F.col("p_name").alias("label"),
        F.array_repeat("p_type", 9).alias("synonyms"),
        F.when(F.col("l_quantity") > 20, "").otherwise(F.concat(F.lit(" made  by\n"), F.repeat("p_brand", F.lit(30)))).alias("definition"),
    )
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(candidate)).alias("candidates"))


_ORDER_CANDIDATES = """
raw AS (
  SELECT DISTINCT l_orderkey, l_quantity AS score, l_partkey AS partkey, 'PART:' || l_partkey AS id, p_name AS label, p_type,
         CASE WHEN l_quantity > 20 THEN '' ELSE ' made  by' || chr(10) || repeat(p_brand, 30) END AS definition
  FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score, partkey) - 1 AS place FROM raw)
"""


def _payload(found: DataFrame, payload: Column) -> DataFrame:
    return found.select("l_orderkey", F.posexplode(payload).alias("place", "c"))


def _short_sql(limit: str) -> str:
    return f"""
SELECT *, CASE WHEN definition <> '' AND place = min(place) FILTER (definition <> '') OVER (PARTITION BY l_orderkey)
          THEN substring('made by ' || trim(replace(replace(definition, ' made  by', ''), chr(10), '')), 1, 160) END AS short
FROM numbered WHERE place < {limit}
"""


def compact_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(_order_candidates(spark, d), P.compact_candidates(F.col("candidates")))
    return rows.select(
        "l_orderkey", F.col("c.index").alias("index"), F.col("c.label").alias("label"),
        F.array_join("c.synonyms", ",").alias("synonyms"), F.col("c.score").alias("score"), F.col("c.definition").alias("definition"),
    )


COMPACT = f"""
WITH {_ORDER_CANDIDATES}, s AS ({_short_sql('5')})
SELECT l_orderkey, place AS index, label, rtrim(repeat(p_type || ',', 8), ',') AS synonyms, score, short AS definition FROM s
"""


def payload_with_id(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(_order_candidates(spark, d), P.compact_candidates_with_id(F.col("candidates"), 3))
    return rows.select("l_orderkey", F.col("c.id").alias("id"), F.col("c.score").alias("score"), F.col("c.definition").alias("definition"))


WITH_ID = f"WITH {_ORDER_CANDIDATES}, s AS ({_short_sql('3')}) SELECT l_orderkey, id, score, short AS definition FROM s"


def verbose_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(_order_candidates(spark, d), P.verbose_candidates(F.col("candidates")))
    return rows.select(
        "l_orderkey", F.col("c.id").alias("id"), F.col("c.score").alias("score"), F.md5("c.definition").alias("definition_md5"),
        F.size("c.synonyms").alias("synonyms"),
    )


VERBOSE = f"""
WITH {_ORDER_CANDIDATES}
SELECT l_orderkey, id, score, md5(definition) AS definition_md5, 8 AS synonyms FROM numbered WHERE place < 8
"""


# ---------------------------------------------------------------- responses


class EchoResponder:
    """Answers with the prompt itself; used to test the asking path."""

    def respond(self, stage: str, prompts: list[dict]) -> list[dict]:
        if any(p["prompt"].endswith("0") for p in prompts):
            raise RuntimeError("refused")
        return [{"text": p["prompt"], "finish_reason": "stop", "prompt_tokens": len(p["prompt"])} for p in prompts]


def responded(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("rec_id"), F.lit("extraction").alias("stage"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("prompt"), F.lit("{}").alias("response_schema"),
    )
    return R.respond_with(EchoResponder)(prompts).select(
        "rec_id", "raw_response", "finish_reason", "prompt_tokens", "model_error"
    )


RESPONDED = """
SELECT o_orderkey::VARCHAR AS rec_id, CASE WHEN NOT fails THEN 'order ' || o_orderkey END AS raw_response,
       CASE WHEN NOT fails THEN 'stop' END AS finish_reason, CASE WHEN NOT fails THEN length('order ' || o_orderkey) END AS prompt_tokens,
       CASE WHEN fails THEN 'RuntimeError: refused' END AS model_error
FROM (SELECT *, o_orderkey % 10 = 0 AS fails FROM orders)
"""


def replayed(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("rec_id"), F.lit("extraction").alias("stage")
    )
    stored = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("rec_id"), F.lit("extraction").alias("stage"),
        F.concat(F.lit("quality "), F.col("quality")).alias("raw_response"), F.lit("stop").alias("finish_reason"),
    )
    return R.replay(stored)(prompts).select("rec_id", "raw_response", "finish_reason", "model_error")


REPLAYED = """
SELECT d.doc_id::VARCHAR AS rec_id, 'quality ' || quality AS raw_response, CASE WHEN quality IS NOT NULL THEN 'stop' END AS finish_reason,
       CASE WHEN quality IS NULL THEN 'LookupError: no stored response' END AS model_error
FROM documents d LEFT JOIN labels USING (doc_id)
"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    inner = F.concat(F.lit('{"conv": '), F.col("conv_id"), F.lit(', "turn": ['), F.col("turn"), F.lit("]}"))
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("```json\n"), inner, F.lit("\n``` ")))
        .when(F.col("role") == "assistant", F.concat(F.lit("Answer: "), inner, F.lit(" done.")))
        .otherwise(F.concat(F.lit("list ["), F.col("turn"), F.lit("] of")))
        .alias("raw_response"),
    )
    texts = table(spark, d, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.concat(F.lit("["), F.col("text")).alias("raw_response")
    )
    read = R.parse_responses(rows.unionByName(texts))
    return read.select("conv_id", "turn", "json", "error")


PARSED = f"""
WITH raw AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN '[' || turn || ']' ELSE '{{"conv": ' || conv_id || ', "turn": [' || turn || ']}}' END AS json
  FROM conversations
), texts AS (SELECT doc_id, {sql_strip("'[' || text")} AS t FROM documents),
spans AS (
  SELECT doc_id, t, CASE WHEN contains(t, '{{') THEN regexp_extract(t, '(?s)[{{].*[}}]') END AS o, regexp_extract(t, '(?s)\\[.*\\]') AS l
  FROM texts
)
SELECT conv_id, turn, json, NULL AS error FROM raw
UNION ALL
SELECT doc_id, -1, json, CASE WHEN t IS NULL THEN 'No response' WHEN json IS NULL THEN '{R.NO_JSON}' END FROM (
  SELECT doc_id, t, CASE WHEN json_valid(t) THEN t WHEN o <> '' AND json_valid(o) THEN o WHEN l <> '' AND json_valid(l) THEN l END AS json FROM spans)
"""


def _event_responses(spark: SparkSession, d: str) -> DataFrame:
    """One response per event: valid, cut off, fenced, out of range or of the wrong shape."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit('{"c":[["event_type","kind","'), k, F.lit('"]]}')))
        .when(kind == "view", F.col("props"))
        .when(kind == "signup", F.concat(F.lit('{"s":['), F.pmod("event_id", F.lit(7)), F.lit("]}")))
        .when(kind == "purchase", F.lit('{"s":[null'))
        .otherwise(F.concat(F.lit('```json\n{"s":['), k, F.lit("]}\n```")))
    )
    finish = F.element_at(F.array(F.lit("stop"), F.lit("length"), F.lit("abort")), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    return spread(events, "event_id").select(
        "event_id",
        F.when(kind.isin("click", "view"), "extraction").otherwise("grounding").alias("stage"),
        raw.alias("raw_response"),
        finish.alias("finish_reason"),
        F.array(F.lit("event_type"), F.lit("value")).alias("fields"),
        F.array(F.lit(4)).alias("candidate_counts"),
    )


def checked(spark: SparkSession, d: str) -> DataFrame:
    rows = R.check_responses(_event_responses(spark, d))
    return rows.select(
        "event_id", "json_valid", "schema_valid", "truncated", "accepted",
        F.array_join("schema_errors", "; ").alias("schema_errors"), F.col("json_error").isNotNull().alias("has_json_error"),
    )


CHECKED = """
WITH e AS (
  SELECT event_id, event_type AS t, user_id % 3 AS f, event_id % 7 AS s FROM events)
SELECT event_id, t IN ('click', 'view', 'signup') AS json_valid,
       CASE WHEN t = 'click' THEN true WHEN t = 'view' THEN false WHEN t = 'signup' THEN s < 4 END AS schema_valid,
       f = 1 AS truncated, f = 0 AND (t = 'click' OR (t = 'signup' AND s < 4)) AS accepted,
       CASE WHEN t = 'view' THEN '''c'' is a required property; Additional properties are not allowed'
            WHEN t = 'signup' AND s >= 4 THEN 'invalid choice at s[0]' ELSE '' END AS schema_errors,
       t NOT IN ('click', 'view', 'signup') AS has_json_error
FROM e
"""


# ---------------------------------------------------------------- reconstruction


def rebuilt_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Two triples per part; small parts name an unknown field, which fails the whole record."""
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.create_map(F.lit("p_name"), F.col("p_name"), F.lit("p_type"), F.col("p_type")).alias("metadata"),
        F.concat(
            F.lit('{"c":[["p_name","thing","'), F.col("p_name"), F.lit('"],["'),
            F.when(F.col("p_size") < 5, "p_none").otherwise("p_type"), F.lit('","kind","the '), F.col("p_type"), F.lit('"]]}'),
        ).alias("raw"),
    )
    shaped = rows.withColumn("shape", R.response_shape(F.col("raw"), F.lit("c")))
    rebuilt = shaped.select(
        "p_partkey",
        R.concepts_error(F.col("shape"), F.col("metadata")).alias("error"),
        F.posexplode_outer(R.reconstruct_concepts(F.col("shape"), F.col("metadata"))).alias("concept_index", "c"),
    )
    return rebuilt.select("p_partkey", "error", "concept_index", "c.concept_type", "c.source_field", "c.raw_value", "c.normalized_query", "c.evidence")


REBUILT_CONCEPTS = """
SELECT p_partkey, NULL AS error, 0 AS concept_index, 'thing' AS concept_type, 'p_name' AS source_field, p_name AS raw_value,
       p_name AS normalized_query, 'p_name=' || p_name AS evidence FROM part WHERE p_size >= 5
UNION ALL
SELECT p_partkey, NULL, 1, 'kind', 'p_type', p_type, 'the ' || p_type, 'p_type=' || p_type FROM part WHERE p_size >= 5
UNION ALL
SELECT p_partkey, 'Invalid source field or empty concept', NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_size < 5
"""


def rebuilt_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The line number selects one of five candidates; returned lines select nothing."""
    candidate = [
        F.struct(
            F.concat(F.lit("PART:"), F.col("l_partkey") + i).alias("id"),
            F.lit(f"label {i}").alias("label"),
            (F.col("l_discount") + i).alias("score"),
        )
        for i in range(6)
    ]
    selection = F.when(F.col("l_returnflag") == "R", "null").when(F.col("l_returnflag") == "A", F.concat((F.col("l_linenumber") - 1).cast("string"))).otherwise(
        F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(".0"))
    )
    # The table is one row group, which one task would read and work on alone.
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_discount"), "l_orderkey")
    rows = lines.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.array(F.struct(F.lit(0).alias("concept_index"), F.array(*candidate).alias("candidates"))).alias("bundles"),
        F.concat(F.lit('{"s":['), selection, F.lit("]}")).alias("raw"),
    )
    shaped = rows.withColumn("shape", R.response_shape(F.col("raw"), F.lit("s")))
    found = shaped.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.inline(R.reconstruct_annotations(F.col("shape"), F.col("bundles")))
    )
    return found.withColumn("retrieval_score", F.round("retrieval_score", 4))


REBUILT_ANNOTATIONS = f"""
SELECT l_orderkey, l_partkey, l_linenumber, 0 AS concept_index, CASE WHEN ok THEN 'matched' ELSE 'unresolved' END AS status,
       CASE WHEN ok THEN 'PART:' || (l_partkey + n) END AS ontology_id, CASE WHEN ok THEN 'label ' || n END AS label,
       CASE WHEN ok THEN '{V.REASON_SELECTED}' || n WHEN l_returnflag = 'R' THEN '{V.REASON_NOT_SELECTED}'
            ELSE '{V.REASON_BAD_INDEX}' END AS reason,
       CASE WHEN ok THEN round(l_discount + n, 4) END AS retrieval_score
FROM (SELECT *, l_linenumber - 1 AS n, l_returnflag = 'A' AND l_linenumber <= 5 AS ok FROM lineitem)
"""


def validated(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    candidates = (
        lines.select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
        .join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("concept_index"),
            F.concat(F.lit("SUP:"), F.col("l_suppkey")).alias("id"), F.col("s_name").alias("label"),
        )
    )
    selected = lines.select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("concept_index"),
        F.when(F.col("l_returnflag") == "N", "unresolved").otherwise("matched").alias("status"),
        F.concat(F.lit("SUP:"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey") + 1000000).otherwise(F.col("l_suppkey"))).alias("ontology_id"),
        F.concat(F.lit("flag "), F.col("l_returnflag")).alias("reason"),
    )
    return R.validate_selected_ids(selected, candidates)


VALIDATED = f"""
SELECT l_orderkey AS rec_id, l_linenumber AS concept_index, CASE WHEN l_returnflag = 'A' THEN 'matched' ELSE 'unresolved' END AS status,
       CASE WHEN l_returnflag = 'A' THEN 'SUP:' || l_suppkey END AS ontology_id, CASE WHEN l_returnflag = 'A' THEN s_name END AS label,
       CASE WHEN l_returnflag = 'R' THEN '{V.REASON_ABSENT_ID}' ELSE 'flag ' || l_returnflag END AS reason
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
"""


# ---------------------------------------------------------------- enrichment


def _part_name_terms(spark: SparkSession, d: str) -> DataFrame:
    return number_terms(
        table(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("first_key")).select(
            F.concat(F.lit("PART:"), F.col("first_key")).alias("id"), F.format_string("part/%012d", "first_key").alias("iri"),
            "label", F.array().cast("array<string>").alias("synonyms"), F.lit("a catalogue part").alias("definition"),
            F.array().cast("array<string>").alias("parents"),
        )
    )


def part_replies(spark: SparkSession, d: str) -> DataFrame:
    """Stored responses of both stages; the part size decides which ones are bad."""
    part = table(spark, d, "part")
    case = F.pmod("p_size", F.lit(8))
    second = F.when(case == 1, "p_unknown").otherwise("p_type")
    extraction = F.when(case == 2, '{"c":[]}').otherwise(
        F.concat(F.lit('{"c":[["p_name","thing","'), F.col("p_name"), F.lit('"],["'), second, F.lit('","kind","'), F.col("p_type"), F.lit('"]]}'))
    )
    grounding = F.when(case == 3, '{"s":[9,null]}').when(case == 4, '{"s":[0').otherwise('{"s":[0,null]}')
    def reply(stage: str, raw: Column, finish: Column, tokens: Column) -> DataFrame:
        return part.filter((case != 5) | F.lit(stage == "extraction")).select(
            F.col("p_partkey").cast("string").alias("rec_id"), F.lit(stage).alias("stage"), raw.alias("raw_response"),
            finish.alias("finish_reason"), F.length(raw).cast("long").alias("prompt_tokens"), tokens.alias("generated_tokens"),
            F.lit(0.5).alias("wall_seconds"),
        )
    first = reply("extraction", extraction, F.when(case == 0, "length").otherwise("stop"), F.col("p_size").cast("long"))
    return first.unionByName(reply("grounding", grounding, F.lit("stop"), F.lit(5).cast("long")))


def part_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return C.canonicalise(rows, keep=["p_partkey"], columns=["p_name", "p_type"]).select(
        F.col("p_partkey").cast("string").alias("rec_id"), "accession", "metadata"
    )


def part_index(spark: SparkSession, d: str) -> I.TermIndex:
    return I.build_index(_part_name_terms(spark, d))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    results = E.enrich(part_records(spark, d), part_index(spark, d), R.replay(part_replies(spark, d)), model="replay")
    return enrichment_columns(results)


def enrichment_columns(results: DataFrame) -> DataFrame:
    first = F.get("concepts", F.lit(0))
    return results.select(
        "rec_id", "status", "failed_stage", "error", F.size("concepts").alias("concepts"),
        first["annotation"]["ontology_id"].alias("first_id"), F.size(first["candidates"]).alias("candidates"),
        F.get("concepts", F.lit(1))["annotation"]["status"].alias("second_status"),
        F.col("diagnostics.grounding.attempted").alias("grounding_attempted"),
        F.col("diagnostics.grounding.skipped_reason").alias("skipped_reason"),
        F.col("diagnostics.extraction.accepted").alias("extraction_accepted"),
        F.col("diagnostics.extraction.reconstruction_error").alias("rebuild_error"),
        F.col("diagnostics.grounding.json_valid").alias("grounding_json"),
        F.col("diagnostics.grounding.schema_valid").alias("grounding_schema"),
    )


ENRICHED = f"""
WITH p AS (
  SELECT p_partkey::VARCHAR AS rec_id, p_size % 8 AS k, p_name FROM part),
n AS (SELECT p_name, 'PART:' || min(p_partkey) AS id FROM part GROUP BY 1)
SELECT rec_id, CASE WHEN k IN (0, 1, 3, 4, 5) THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN k IN (0, 1) THEN 'concept_extraction' WHEN k IN (3, 4, 5) THEN 'grounding' END AS failed_stage,
       CASE WHEN k = 5 THEN 'StageFailure: Model call failed' WHEN k IN (0, 1, 3, 4) THEN 'StageFailure: {V.REFUSED_OUTPUT}' END AS error,
       CASE WHEN k IN (0, 1, 2) THEN 0 ELSE 2 END AS concepts, CASE WHEN k >= 6 THEN id END AS first_id,
       CASE WHEN k >= 3 THEN 5 END AS candidates, CASE WHEN k >= 6 THEN 'unresolved' END AS second_status,
       k >= 3 AS grounding_attempted,
       CASE WHEN k IN (0, 1) THEN '{V.SKIP_PREVIOUS_STAGE}concept_extraction' WHEN k = 2 THEN '{V.SKIP_NO_CONCEPTS}' END AS skipped_reason,
       k >= 2 AS extraction_accepted, NULL AS rebuild_error,
       CASE WHEN k IN (3, 6, 7) THEN true WHEN k = 4 THEN false END AS grounding_json,
       CASE WHEN k = 3 THEN false WHEN k IN (6, 7) THEN true END AS grounding_schema
FROM p JOIN n USING (p_name)
"""


def annotated_table(spark: SparkSession, d: str) -> DataFrame:
    """The plain table flow: all parts, two fields, every reply good."""
    part = table(spark, d, "part")
    replies = part.select(
        F.col("p_partkey").cast("string").alias("rec_id"),
        F.inline(F.array(
            F.struct(F.lit("extraction").alias("stage"),
                     F.concat(F.lit('{"c":[["p_name","thing","'), F.col("p_name"), F.lit('"]]}')).alias("raw_response")),
            F.struct(F.lit("grounding").alias("stage"), F.lit('{"s":[0]}').alias("raw_response")),
        )),
    ).withColumn("finish_reason", F.lit("stop"))
    index = I.build_index(_part_name_terms(spark, d))
    rows = E.annotate_table(part, index, R.replay(replies), "p_partkey", fields=["p_type", "p_name"], include_candidates=True)
    c = F.get("concepts", F.lit(0))
    return rows.select(
        "rec_id", F.array_join(F.map_keys("metadata"), ",").alias("fields"), c["evidence"].alias("evidence"),
        c["annotation"]["ontology_id"].alias("ontology_id"), c["annotation"]["label"].alias("label"),
        c["annotation"]["reason"].alias("reason"), F.size(c["candidates"]).alias("candidates"),
    )


ANNOTATED = f"""
SELECT p_partkey::VARCHAR AS rec_id, 'p_type,p_name' AS fields, 'p_name=' || p_name AS evidence, id AS ontology_id, p_name AS label,
       '{V.REASON_SELECTED}0' AS reason, 5 AS candidates
FROM part JOIN (SELECT p_name, 'PART:' || min(p_partkey) AS id FROM part GROUP BY 1) USING (p_name)
"""

QUERIES = {
    "extraction_prompt": extraction_prompts,
    "compact_candidates": compact_payload,
    "compact_candidates_with_id": payload_with_id,
    "verbose_candidates": verbose_payload,
    "respond": responded,
    "replay": replayed,
    "parse_responses": parsed,
    "check_responses": checked,
    "reconstruct_concepts": rebuilt_concepts,
    "reconstruct_annotations": rebuilt_annotations,
    "validate_selected_ids": validated,
    "enrich": enriched,
    "annotate_table": annotated_table,
}
ORACLES = {
    "extraction_prompt": EXTRACTION_PROMPTS,
    "compact_candidates": COMPACT,
    "compact_candidates_with_id": WITH_ID,
    "verbose_candidates": VERBOSE,
    "respond": RESPONDED,
    "replay": REPLAYED,
    "parse_responses": PARSED,
    "check_responses": CHECKED,
    "reconstruct_concepts": REBUILT_CONCEPTS,
    "reconstruct_annotations": REBUILT_ANNOTATIONS,
    "validate_selected_ids": VALIDATED,
    "enrich": ENRICHED,
    "annotate_table": ANNOTATED,
}
