"""Queries over summaries, audit and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.catalog.common import sql_strip, table
from termloom.functions.text import strip_fence
from termloom.operators import compare as A
from termloom.operators import summary as S

# ---------------------------------------------------------------- statistics


def statistics(spark: SparkSession, d: str) -> DataFrame:
    found = S.numeric_statistics(table(spark, d, "documents"), "n_chars", ["lang"])
    return _rounded(found, 4)


def _rounded(df: DataFrame, places: int) -> DataFrame:
    return df.select(
        *[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def _statistics_sql(value: str, source: str, keys: str, places: int) -> str:
    points = ", ".join(
        f"round(quantile_cont({value}::DOUBLE, {p}), {places}) AS {n}"
        for p, n in zip(S.STATISTIC_POINTS, S.STATISTIC_NAMES)
    )
    return f"""
SELECT {keys}, count({value}) AS count, round(coalesce(sum({value}::DOUBLE), 0), {places}) AS total,
       round(avg({value}::DOUBLE), {places}) AS mean, round(min({value}::DOUBLE), {places}) AS min, {points},
       round(max({value}::DOUBLE), {places}) AS max
FROM {source} GROUP BY {keys}
"""


def ranked_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Groups with very many distinct values."""
    found = S.numeric_statistics(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return _rounded(found, 4)


def distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.distribution(table(spark, d, "events"), "value", ["event_type"]), 4)


DISTRIBUTION = "SELECT event_type, " + ", ".join(
    f"round(quantile_cont(value, {p}), 4) AS {n}" for p, n in zip(S.DISTRIBUTION_POINTS, S.DISTRIBUTION_NAMES)
) + " FROM events GROUP BY event_type"


def token_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("tokens", F.length("text"))
    p99 = S.exact_percentiles(rows, "tokens", (0.99,), ("p99",), ["role"])
    return p99.select("role", S.token_cap_suggestion(F.col("p99")).alias("cap"))


TOKEN_CAPS = """
SELECT role, (ceil(quantile_cont(length(text)::DOUBLE, 0.99) * 1.25 / 16) * 16)::BIGINT AS cap FROM conversations GROUP BY 1
"""


# ---------------------------------------------------------------- roll-ups


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """One model call per conversation turn; first turns are skipped."""
    turn = F.col("turn")
    tried = turn > 0
    error = F.when(tried & (F.pmod("conv_id", F.lit(10)) == 0), "RuntimeError: out of context")
    tested = tried & error.isNull()
    return table(spark, d, "conversations").select(
        F.col("role").alias("stage"), "conv_id", "turn",
        tried.alias("attempted"),
        F.when(tested, F.length("text")).alias("prompt_tokens"),
        F.when(tested, turn * 3).alias("generated_tokens"),
        F.when(tried, F.lit(0.25)).otherwise(0.0).alias("wall_seconds"),
        F.when(tested, F.when(turn == 2, "length").otherwise("stop")).alias("finish_reason"),
        F.when(tested, turn == 2).alias("truncated"),
        F.when(tested, turn != 3).alias("json_valid"),
        F.when(tested & (turn != 3), F.pmod("conv_id", F.lit(4)) != 0).alias("schema_valid"),
        error.alias("model_error"),
    )


_CALLS = """
calls AS (
  SELECT role AS stage, conv_id, turn, turn > 0 AS attempted, CASE WHEN tested THEN length(text) END AS prompt_tokens,
         CASE WHEN tested THEN turn * 3 END AS generated_tokens, CASE WHEN turn > 0 THEN 0.25::DOUBLE ELSE 0 END AS wall_seconds,
         CASE WHEN tested THEN CASE WHEN turn = 2 THEN 'length' ELSE 'stop' END END AS finish_reason,
         CASE WHEN tested THEN turn = 2 END AS truncated, CASE WHEN tested THEN turn <> 3 END AS json_valid,
         CASE WHEN tested AND turn <> 3 THEN conv_id % 4 <> 0 END AS schema_valid,
         turn > 0 AND conv_id % 10 = 0 AS errored
  FROM (SELECT *, turn > 0 AND conv_id % 10 <> 0 AS tested FROM conversations))
"""


def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.stage_rollup(_calls(spark, d)), 6)


STAGE_ROLLUP = f"""
WITH {_CALLS}, r AS (
  SELECT stage, count(*) FILTER (attempted) AS attempted_records, count(*) FILTER (NOT attempted) AS skipped_records,
         count(*) FILTER (truncated) AS truncated_records, count(*) FILTER (NOT json_valid) AS json_failures,
         count(*) FILTER (NOT schema_valid) AS schema_failures, count(json_valid) AS json_evaluated_records,
         count(schema_valid) AS schema_evaluated_records, count(*) FILTER (errored) AS model_errors,
         coalesce(sum(wall_seconds) FILTER (attempted), 0)::DOUBLE AS wall_seconds,
         coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens_total, coalesce(sum(generated_tokens), 0)::BIGINT AS generated_tokens_total
  FROM calls GROUP BY stage)
SELECT *, round(truncated_records::DOUBLE / nullif(attempted_records, 0), 6) AS truncation_rate,
       round(json_failures::DOUBLE / nullif(attempted_records, 0), 6) AS json_failure_rate,
       round(schema_failures::DOUBLE / nullif(attempted_records, 0), 6) AS schema_failure_rate,
       round(attempted_records::DOUBLE / nullif(wall_seconds, 0), 6) AS records_per_second
FROM r
"""


def finish_reasons(spark: SparkSession, d: str) -> DataFrame:
    return S.finish_reasons(_calls(spark, d))


FINISH_REASONS = f"""
WITH {_CALLS} SELECT stage, finish_reason, count(*) AS calls FROM calls WHERE attempted AND finish_reason IS NOT NULL GROUP BY 1, 2
"""


def stage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.stage_token_statistics(_calls(spark, d), "prompt_tokens"), 4)


STAGE_TOKENS = f"WITH {_CALLS} " + _statistics_sql("prompt_tokens", "(SELECT * FROM calls WHERE attempted)", "stage", 4)


def order_results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as enrichment results, their line items as concepts; an order has few lines."""
    status = F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "R", "unresolved")
    concept = F.struct(
        F.when(status.isNotNull(), F.struct(status.alias("status"), F.col("l_partkey").alias("ontology_id"))).alias("annotation")
    )
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(concept).alias("concepts"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    failed = F.when(F.col("o_orderstatus") == "P", "grounding").when(F.col("o_orderpriority") == "5-LOW", "concept_extraction")
    cut = F.col("o_orderpriority") == "1-URGENT"

    def stage(attempted, tokens):
        return F.struct(
            attempted.alias("attempted"), F.when(attempted, tokens).alias("prompt_tokens"),
            F.when(attempted, F.lit(7).cast("long")).alias("generated_tokens"),
            F.when(attempted, F.lit(0.25)).alias("wall_seconds"),
            F.when(attempted, F.when(cut, "length").otherwise("stop")).alias("finish_reason"),
            F.when(attempted, cut).alias("truncated"),
            F.when(attempted, ~cut).alias("json_valid"),
            F.when(attempted & ~cut, F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("schema_valid"),
            F.lit(None).cast("string").alias("model_error"),
        )
    return orders.select(
        F.col("o_orderkey").cast("string").alias("rec_id"),
        F.coalesce("concepts", F.array().cast(lines.schema["concepts"].dataType)).alias("concepts"),
        F.when(failed.isNull(), "completed").otherwise("failed").alias("status"),
        failed.alias("failed_stage"),
        F.struct(
            stage(F.lit(True), F.col("o_custkey")).alias("extraction"),
            stage(F.coalesce(failed != "concept_extraction", F.lit(True)), F.lit(100).cast("long")).alias("grounding"),
            F.lit(0.5).alias("retrieval_seconds"),
            F.lit(2.0).alias("record_wall_seconds"),
        ).alias("diagnostics"),
    )


_RESULTS = """
results AS (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'grounding' WHEN o_orderpriority = '5-LOW' THEN 'concept_extraction' END AS failed_stage
  FROM orders)
"""


def record_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.record_rollup(order_results(spark, d))


RECORD_ROLLUP = f"""
WITH {_RESULTS}, r AS (
  SELECT count(*) AS processed_records, count(*) FILTER (failed_stage IS NULL) AS completed_records,
         count(*) FILTER (failed_stage IS NOT NULL) AS failed_records, count(*) * 0.5::DOUBLE AS retrieval_wall_seconds,
         count(*) * 2.0::DOUBLE AS record_wall_seconds,
         (sum(o_custkey) + sum(CASE WHEN failed_stage IS DISTINCT FROM 'concept_extraction' THEN 100 ELSE 0 END))::BIGINT AS total_prompt_tokens,
         (sum(7) + sum(CASE WHEN failed_stage IS DISTINCT FROM 'concept_extraction' THEN 7 ELSE 0 END))::BIGINT AS total_generated_tokens
  FROM results),
c AS (
  SELECT count(*) AS total_concepts, count(*) FILTER (l_returnflag = 'A') AS matched_annotations,
         count(*) FILTER (l_returnflag = 'R') AS unresolved_annotations,
         count(*) FILTER (l_returnflag = 'N') AS concepts_without_annotations
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT * FROM r, c
"""


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole summary, its maps and structs taken apart."""
    results = order_results(spark, d)
    provenance = results.agg(F.count("*").alias("population_records")).select(F.lit("all").alias("method"), "population_records")
    return flat_summary(S.run_summary(results, provenance))


def flat_summary(found: DataFrame) -> DataFrame:
    extraction, grounding = F.col("stages")["extraction"], F.col("stages")["grounding"]
    return _rounded(
        found.select(
            *found.columns[: found.columns.index("records_per_second")], "records_per_second", "completed_records_per_second",
            *[F.coalesce(F.col("failures_by_stage")[s], F.lit(0)).alias(f"{s}_failures") for s in ("grounding", "concept_extraction")],
            F.col("concepts_per_record.mean").alias("concepts_mean"), F.col("concepts_per_record.p90").alias("concepts_p90"),
            extraction["attempted_records"].alias("extraction_attempted"), grounding["skipped_records"].alias("grounding_skipped"),
            extraction["truncation_rate"].alias("extraction_truncation_rate"),
            grounding["schema_failures"].alias("grounding_schema_failures"),
            grounding["records_per_second"].alias("grounding_records_per_second"),
            extraction["finish_reasons"]["length"].alias("extraction_length_stops"),
            grounding["finish_reasons"]["stop"].alias("grounding_stops"),
            extraction["prompt_tokens_statistics"]["p95"].alias("extraction_prompt_p95"),
            grounding["generated_tokens_statistics"]["total"].alias("grounding_generated_total"),
            F.col("sample_input.method").alias("method"), F.col("sample_input.population_records").alias("population_records"),
        ),
        6,
    )


RUN_SUMMARY = f"""
WITH rolled AS ({RECORD_ROLLUP}), {_RESULTS},
flags AS (
  SELECT *, o_orderpriority = '1-URGENT' AS cut, failed_stage IS DISTINCT FROM 'concept_extraction' AS grounded FROM results),
n AS (SELECT o_orderkey, count(l_orderkey) AS concepts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
f AS (
  SELECT round(count(*) / (count(*) * 2.0::DOUBLE), 6) AS records_per_second,
         round(count(*) FILTER (failed_stage IS NULL) / (count(*) * 2.0::DOUBLE), 6) AS completed_records_per_second,
         count(*) FILTER (failed_stage = 'grounding') AS grounding_failures,
         count(*) FILTER (failed_stage = 'concept_extraction') AS concept_extraction_failures,
         count(*) AS extraction_attempted, count(*) FILTER (NOT grounded) AS grounding_skipped,
         round(count(*) FILTER (cut) / count(*)::DOUBLE, 6) AS extraction_truncation_rate,
         count(*) FILTER (grounded AND NOT cut AND o_orderpriority = '4-NOT SPECIFIED') AS grounding_schema_failures,
         4.0::DOUBLE AS grounding_records_per_second, count(*) FILTER (cut) AS extraction_length_stops,
         count(*) FILTER (grounded AND NOT cut) AS grounding_stops,
         round(quantile_cont(o_custkey::DOUBLE, 0.95), 6) AS extraction_prompt_p95,
         7.0::DOUBLE * count(*) FILTER (grounded) AS grounding_generated_total, 'all' AS method, count(*) AS population_records
  FROM flags),
c AS (SELECT round(avg(concepts), 6) AS concepts_mean, round(quantile_cont(concepts::DOUBLE, 0.9), 6) AS concepts_p90 FROM n)
SELECT * FROM rolled, f, c
"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    return S.failures_by_stage(order_results(spark, d))


FAILURES = f"WITH {_RESULTS} SELECT failed_stage, count(*) AS records FROM results WHERE failed_stage IS NOT NULL GROUP BY 1"


def concept_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.numeric_statistics(S.concepts_per_record(order_results(spark, d)), "concepts"), 4)


CONCEPT_STATISTICS = """
WITH n AS (SELECT o_orderkey, count(l_orderkey) AS concepts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
""" + _statistics_sql("concepts", "n", "1::INT AS one", 4).replace("SELECT 1::INT AS one, ", "SELECT ").replace("GROUP BY 1::INT AS one", "")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("concept_index"), "l_linestatus",
        F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "R", "unresolved").alias("status"),
        F.concat(F.lit("PART:"), F.col("l_partkey")).alias("ontology_id"),
        F.when(F.col("l_returnflag") == "R", "x; rejected by validator").alias("reason"),
    )


def annotation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.annotation_rollup(_annotations(spark, d), ["l_linestatus"])


ANNOTATION_ROLLUP = """
SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS matched_annotations,
       count(*) FILTER (l_returnflag = 'R') AS unresolved_annotations,
       count(*) FILTER (l_returnflag = 'N') AS concepts_without_annotations FROM lineitem GROUP BY 1
"""


def id_frequency(spark: SparkSession, d: str) -> DataFrame:
    return S.id_frequency(_annotations(spark, d))


ID_FREQUENCY = "SELECT 'PART:' || l_partkey AS ontology_id, count(*) AS annotations FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1"


def _line_results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results with metadata; the raw value of a line's concept is its order's priority, or that of no order."""
    status = F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "R", "unresolved")
    concept = F.struct(
        F.when(F.col("l_linestatus") == "F", "priority").otherwise("no_field").alias("source_field"),
        F.when(F.col("l_linenumber") == 7, "other").otherwise(F.col("o_orderpriority")).alias("raw_value"),
        F.when(status.isNotNull(), F.struct(status.alias("status"), F.col("l_partkey").cast("string").alias("ontology_id"))).alias("annotation"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_orderkey").alias("rec_id"), "o_orderpriority").agg(F.collect_list(F.struct("l_linenumber", concept.alias("c"))).alias("l")).select(
        "rec_id", F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"), F.array_sort("l")["c"].alias("concepts")
    )


def result_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.result_counts(_line_results(spark, d), "priority")


RESULT_COUNTS = """
WITH l AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'status' AS measure, CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'R' THEN 'unresolved' END AS value, count(*) AS n FROM l GROUP BY 2
UNION ALL SELECT 'ontology_id', l_partkey::VARCHAR, count(*) FROM l WHERE l_returnflag = 'A' GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(DISTINCT o_orderkey) FROM l GROUP BY 2
"""


def value_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return S.source_value_mismatches(_line_results(spark, d))


VALUE_MISMATCHES = """
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY l_linenumber, source_field, raw_value) - 1 AS concept_index, * EXCLUDE (rec_id, l_linenumber) FROM (
  SELECT o_orderkey AS rec_id, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'priority' ELSE 'no_field' END AS source_field,
    CASE WHEN l_linenumber = 7 THEN 'other' ELSE o_orderpriority END AS raw_value,
    CASE WHEN l_linestatus = 'F' THEN o_orderpriority END AS source_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
QUALIFY raw_value IS DISTINCT FROM source_value
"""


def throughput(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.when(F.col("processed_records") > 0, F.col("record_wall_seconds"))
    rolled = S.record_rollup(order_results(spark, d)).select(
        *S.throughput(F.col("processed_records"), F.col("completed_records"), seconds)
    )
    return _rounded(rolled, 6)


THROUGHPUT = f"""
WITH {_RESULTS}
SELECT round(count(*) / (count(*) * 2.0::DOUBLE), 6) AS records_per_second,
       round(count(*) FILTER (failed_stage IS NULL) / (count(*) * 2.0::DOUBLE), 6) AS completed_records_per_second FROM results
"""


def run_throughput(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d).select(
        F.col("stage").alias("run_id"), "prompt_tokens", "generated_tokens", "finish_reason", F.lit(12.5).alias("run_seconds")
    )
    return _rounded(S.run_throughput(calls), 6)


RUN_THROUGHPUT = f"""
WITH {_CALLS}, r AS (
  SELECT stage AS run_id, count(*) AS records, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(generated_tokens)::BIGINT AS generated_tokens,
         12.5::DOUBLE AS wall_seconds, count(*) FILTER (finish_reason = 'length') AS length_stops FROM calls GROUP BY 1)
SELECT *, round(generated_tokens / wall_seconds, 6) AS generated_tokens_per_second,
       round((prompt_tokens + generated_tokens) / wall_seconds, 6) AS total_tokens_per_second,
       round(records / wall_seconds, 6) AS records_per_second FROM r
"""


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(
        F.col("event_type").alias("run_id"), F.date_format("ts", "yyyy-MM").alias("phase"),
        F.col("value").alias("utilization_percent"), F.col("user_id").cast("double").alias("used_mib"),
    )
    return _rounded(S.telemetry_rollup(samples), 4)


TELEMETRY = """
SELECT event_type AS run_id, strftime(ts, '%Y-%m') AS phase, count(*) AS samples, round(avg(value), 4) AS utilization_mean,
       round(min(value), 4) AS utilization_min, round(max(value), 4) AS utilization_peak, max(user_id)::DOUBLE AS peak_used_mib,
       round(quantile_cont(value, 0.5), 4) AS utilization_median FROM events GROUP BY 1, 2
"""


def metadata_lost(spark: SparkSession, d: str) -> DataFrame:
    """Records whose metadata changed: here the supplier balance is dropped when negative."""
    def records(keep_negative: bool) -> DataFrame:
        balance = F.when((F.col("s_acctbal") >= 0) | F.lit(keep_negative), F.col("s_acctbal").cast("string"))
        return table(spark, d, "supplier").select(
            F.col("s_suppkey").alias("rec_id"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("balance"), balance).alias("metadata")
        )
    return S.metadata_lost(records(True), records(False))


# ---------------------------------------------------------------- audit


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("role", "conv_id", "turn")
    return A.occurrence_number(rows, ["role"], ["conv_id", "turn"])


OCCURRENCES = """
SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS occurrence FROM conversations
"""


def fences(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("```JSON \n"), F.col("text"), F.lit("\n``` "))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(strip_fence(fenced)).alias("text_md5"))


FENCES = f"SELECT doc_id, md5({sql_strip('text')}) AS text_md5 FROM documents"


def audit_rows(conversations: DataFrame) -> DataFrame:
    """Responses with a list of the line's text and as many members as the turn number; user turns are cut off."""
    member = F.when(F.col("role") == "system", "annotations").otherwise("concepts")
    objects = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn")), lambda i: F.when(i == 0, F.to_json(F.struct("text"))).otherwise(F.concat(F.lit('{"i": '), i.cast("string"), F.lit("}")))), ", ")
    tail = F.when(F.col("role") == "user", ', {"i": ').otherwise("]}")
    return conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "system", "grounding").otherwise("extraction").alias("pass"),
        F.when(F.col("role") == "user", "length").otherwise("stop").alias("finish_reason"),
        F.concat(F.lit('```json\n{"'), member, F.lit('": ['), objects, tail, F.when(F.col("role") != "user", "\n```").otherwise("")).alias("text"),
    )


def _audited(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_response(audit_rows(table(spark, d, "conversations")))


AUDIT_COLUMNS = (
    "conv_id", "turn", "pass", "json_valid", "truncated", "parsed_items", "complete_partial_objects", "closing_present",
    "length(response_tail) AS tail_length",
)


def audited(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).selectExpr(*AUDIT_COLUMNS)


_AUDIT = """
audit AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'grounding' ELSE 'extraction' END AS pass, role <> 'user' AS json_valid,
         role = 'user' AS truncated, CASE WHEN role <> 'user' THEN turn + 1 END AS parsed_items, turn + 1 AS complete_partial_objects,
         role <> 'user' AS closing_present,
         least(100, CASE WHEN role = 'system' THEN 17 ELSE 14 END + length(to_json({'text': text})::VARCHAR) + turn * 10 + CASE WHEN role = 'user' THEN 7 ELSE 2 END) AS tail_length
  FROM conversations)
"""
AUDITED = f"""
WITH {_AUDIT}
SELECT conv_id, turn, pass, json_valid, truncated, parsed_items, complete_partial_objects, closing_present, tail_length FROM audit
"""


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(A.audit_summary(_audited(spark, d)), 6)


AUDIT_SUMMARY = f"""
WITH {_AUDIT}
SELECT pass, count(*) AS responses, count(*) FILTER (json_valid) AS valid_json, round(avg(truncated::INT), 6) AS truncation_rate,
       count(*) FILTER (closing_present) AS closing_delimiters FROM audit GROUP BY 1
"""


def partial_objects(spark: SparkSession, d: str) -> DataFrame:
    return A.partial_object_histogram(_audited(spark, d))


PARTIAL = f"WITH {_AUDIT} SELECT pass, complete_partial_objects, count(*) AS responses FROM audit GROUP BY 1, 2"


# ---------------------------------------------------------------- agreement


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Two documents in a row form one record; its documents are the concepts."""
    return table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 2).alias("rec_id")).agg(F.count("*").alias("n_concepts"))


def _run(spark: SparkSession, d: str, column: str) -> DataFrame:
    value = F.col(column)
    return table(spark, d, "labels").select(
        F.floor(F.col("doc_id") / 2).alias("rec_id"), F.pmod("doc_id", F.lit(2)).cast("int").alias("concept_index"),
        F.when(value == 1, "matched").otherwise("unresolved").alias("status"),
        F.when(value == 1, F.lit("LABEL:1")).alias("ontology_id"),
    )


_RUNS = """
d AS (SELECT doc_id // 2 AS rec_id, doc_id % 2 AS concept_index, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT doc_id // 2 AS rec_id, doc_id % 2 AS concept_index, quality, toxic FROM labels)
"""


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return A.signatures(_run(spark, d, "quality"), _counts(spark, d))


SIGNATURES = f"""
WITH {_RUNS}
SELECT rec_id, concept_index, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'matched' ELSE 'unresolved' END AS status,
       CASE WHEN quality = 1 THEN 'LABEL:1' END AS ontology_id FROM d
"""


def agreement(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    a, b = (A.signatures(_run(spark, d, c), counts) for c in ("quality", "toxic"))
    return _rounded(A.agreement(a, b), 6)


AGREEMENT = f"""
WITH {_RUNS}, r AS (
  SELECT rec_id, bool_or(quality IS NULL) AS missing, bool_and(quality = toxic) AS exact, count(*) FILTER (quality = toxic) AS equal,
         count(*) AS compared FROM d GROUP BY 1)
SELECT count(*) AS comparable_records, round(count(*) FILTER (exact) / nullif(count(*), 0)::DOUBLE, 6) AS exact_record_agreement,
       round(sum(equal) / nullif(sum(compared), 0)::DOUBLE, 6) AS concept_agreement, coalesce(sum(equal), 0)::BIGINT AS equal_concepts,
       coalesce(sum(compared), 0)::BIGINT AS compared_concepts FROM r WHERE NOT missing
"""


def ordered_parity(spark: SparkSession, d: str) -> DataFrame:
    return A.ordered_parity(_run(spark, d, "quality"), _run(spark, d, "toxic"))


ORDERED = f"WITH {_RUNS} SELECT rec_id, bool_and(quality = toxic) AS parity FROM l GROUP BY 1"


def multiset_parity(spark: SparkSession, d: str) -> DataFrame:
    return A.multiset_parity(_run(spark, d, "quality"), _run(spark, d, "toxic"))


MULTISET = f"WITH {_RUNS} SELECT rec_id, sum(quality) = sum(toxic) AS parity FROM l GROUP BY 1"


def acceptance(spark: SparkSession, d: str) -> DataFrame:
    a, b = _run(spark, d, "quality"), _run(spark, d, "toxic")
    return _rounded(A.acceptance_gate(A.ordered_parity(a, b), A.multiset_parity(a, b)), 6)


ACCEPTANCE = f"""
WITH {_RUNS}, r AS (SELECT rec_id, sum(quality) = sum(toxic) AS bag, bool_and(quality = toxic) AS ordered FROM l GROUP BY 1)
SELECT round(avg(ordered::INT), 6) AS fixed_agreement, round(avg(bag::INT), 6) AS end_to_end_agreement,
       bool_and(bag) AND bool_and(ordered) AS acceptance_passed FROM r
"""


def acceptance_records(spark: SparkSession, d: str) -> DataFrame:
    a, b = _run(spark, d, "quality"), _run(spark, d, "toxic")
    matched = b.filter("status = 'matched'")
    return A.acceptance_records(A.ordered_parity(a, b), A.multiset_parity(a, b), a, matched)


ACCEPTANCE_RECORDS = f"""
WITH {_RUNS}
SELECT rec_id, bool_and(quality = toxic) AS fixed_parity, sum(quality) = sum(toxic) AS end_to_end_parity,
       count(*) AS extracted_concepts, count(*) FILTER (toxic = 1) AS reference_concepts FROM l GROUP BY 1
"""


def complete_records(spark: SparkSession, d: str) -> DataFrame:
    return A.complete_records(_run(spark, d, "quality"), _counts(spark, d))


COMPLETE = f"WITH {_RUNS} SELECT rec_id, bool_and(quality IS NOT NULL) AS complete FROM d GROUP BY 1"


def rejected(spark: SparkSession, d: str) -> DataFrame:
    return A.rejected_ids(_annotations(spark, d))


def outside(spark: SparkSession, d: str) -> DataFrame:
    """Annotations checked against candidates that leave out the cheaper suppliers' lines."""
    candidates = table(spark, d, "lineitem").filter(F.col("l_quantity") > 10).select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("concept_index"),
        F.concat(F.lit("PART:"), F.col("l_partkey")).alias("id"),
    )
    return A.outside_candidates(_annotations(spark, d), candidates).groupBy("rec_id").agg(F.count("*").alias("outside"))


OUTSIDE = """
SELECT l_orderkey AS rec_id, count(*) AS outside FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (
  SELECT 1 FROM lineitem b WHERE b.l_quantity > 10 AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
  AND a.l_partkey = b.l_partkey) GROUP BY 1
"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    one = A.signatures(_run(spark, d, "quality"), counts).withColumn("variant", F.lit("quality")).withColumn("cap", F.lit(96))
    two = A.signatures(_run(spark, d, "toxic"), counts).withColumn("variant", F.lit("toxic")).withColumn("cap", F.lit(768))
    base = A.signatures(_run(spark, d, "toxic"), counts)
    return _rounded(A.variant_compare(one.unionByName(two), base), 6)


VARIANTS = f"""
WITH {_RUNS}, v AS (
  SELECT 'quality' AS variant, 96 AS cap, rec_id, quality AS a, toxic AS b FROM d
  UNION ALL SELECT 'toxic', 768, rec_id, toxic, toxic FROM d),
r AS (
  SELECT variant, cap, rec_id, bool_or(a IS NULL) AS missing, bool_and(a = b) AS exact, count(*) FILTER (a = b) AS equal,
         count(*) AS compared FROM v GROUP BY 1, 2, 3)
SELECT variant, cap, count(*) AS comparable_records, round(count(*) FILTER (exact) / count(*)::DOUBLE, 6) AS exact_record_agreement,
       round(sum(equal) / sum(compared)::DOUBLE, 6) AS concept_agreement, sum(equal)::BIGINT AS equal_concepts,
       sum(compared)::BIGINT AS compared_concepts FROM r WHERE NOT missing GROUP BY 1, 2
"""

QUERIES = {
    "numeric_statistics": statistics,
    "numeric_statistics_by_ranks": ranked_statistics,
    "distribution": distribution,
    "token_cap_suggestion": token_caps,
    "stage_rollup": stage_rollup,
    "finish_reasons": finish_reasons,
    "stage_token_statistics": stage_tokens,
    "record_rollup": record_rollup,
    "run_summary": run_summary,
    "failures_by_stage": failures,
    "concept_count_statistics": concept_statistics,
    "annotation_rollup": annotation_rollup,
    "id_frequency": id_frequency,
    "result_counts": result_counts,
    "source_value_mismatches": value_mismatches,
    "throughput": throughput,
    "run_throughput": run_throughput,
    "telemetry_rollup": telemetry,
    "metadata_lost": metadata_lost,
    "occurrence_number": occurrences,
    "strip_fence": fences,
    "audit_response": audited,
    "audit_summary": audit_summary,
    "partial_object_histogram": partial_objects,
    "signatures": signatures,
    "agreement": agreement,
    "ordered_parity": ordered_parity,
    "multiset_parity": multiset_parity,
    "acceptance_gate": acceptance,
    "acceptance_records": acceptance_records,
    "complete_records": complete_records,
    "rejected_ids": rejected,
    "candidate_membership": outside,
    "variant_compare": variants,
}
ORACLES = {
    "numeric_statistics": _statistics_sql("n_chars", "documents", "lang", 4),
    "numeric_statistics_by_ranks": _statistics_sql("l_extendedprice", "lineitem", "l_returnflag", 4),
    "distribution": DISTRIBUTION,
    "token_cap_suggestion": TOKEN_CAPS,
    "stage_rollup": STAGE_ROLLUP,
    "finish_reasons": FINISH_REASONS,
    "stage_token_statistics": STAGE_TOKENS,
    "record_rollup": RECORD_ROLLUP,
    "run_summary": RUN_SUMMARY,
    "failures_by_stage": FAILURES,
    "concept_count_statistics": CONCEPT_STATISTICS,
    "annotation_rollup": ANNOTATION_ROLLUP,
    "id_frequency": ID_FREQUENCY,
    "result_counts": RESULT_COUNTS,
    "source_value_mismatches": VALUE_MISMATCHES,
    "throughput": THROUGHPUT,
    "run_throughput": RUN_THROUGHPUT,
    "telemetry_rollup": TELEMETRY,
    "metadata_lost": "SELECT s_suppkey AS rec_id FROM supplier WHERE s_acctbal < 0",
    "occurrence_number": OCCURRENCES,
    "strip_fence": FENCES,
    "audit_response": AUDITED,
    "audit_summary": AUDIT_SUMMARY,
    "partial_object_histogram": PARTIAL,
    "signatures": SIGNATURES,
    "agreement": AGREEMENT,
    "ordered_parity": ORDERED,
    "multiset_parity": MULTISET,
    "acceptance_gate": ACCEPTANCE,
    "acceptance_records": ACCEPTANCE_RECORDS,
    "complete_records": COMPLETE,
    "rejected_ids": "SELECT count(*) FILTER (l_returnflag = 'R') AS rejected_ids FROM lineitem",
    "candidate_membership": OUTSIDE,
    "variant_compare": VARIANTS,
}
