"""Quality summaries of enrichment results: counts, rates, exact percentiles, throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.plans.staging import shuffle_width, write_stage

# Percentiles of the statistics blocks.
STATISTIC_POINTS = (0.5, 0.9, 0.95, 0.99)
STATISTIC_NAMES = ("median", "p90", "p95", "p99")
DISTRIBUTION_POINTS = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)
DISTRIBUTION_NAMES = ("min", "median", "p90", "p95", "p99", "max")


def _value_counts(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: Sequence[float],
    names: Sequence[str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Exact, linearly interpolated percentiles of ``value`` per ``group``.

    Equal values are counted where they are. The counts are ranked by a prefix sum over range
    partitions, so no task sees a whole group, and only values at the wanted ranks are gathered.
    """
    counts = _value_counts(df, value, group)
    keys = list(group)
    width = shuffle_width(counts.sparkSession)
    ranged = counts.repartitionByRange(width, *keys, "v").withColumn("part", F.spark_partition_id())
    ranged = write_stage(ranged, "value-counts")
    totals = ranged.groupBy(*keys).agg(F.sum("n").alias("total"))
    parts = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("part_n"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "part", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = join_groups(ranged.withColumn("within", F.sum("n").over(within)), starts, [*keys, "part"])
    ends = ends.withColumn("last", F.col("start") + F.col("within") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    placed = join_groups(ends, totals, keys)
    columns = []
    for point, name in zip(points, names):
        place = (F.col("total") - 1) * F.lit(float(point))
        low, high = F.floor(place), F.ceil(place)
        at_low = F.max(F.when((F.col("first") <= low) & (low <= F.col("last")), F.col("v")))
        at_high = F.max(F.when((F.col("first") <= high) & (high <= F.col("last")), F.col("v")))
        columns.append((at_low + (at_high - at_low) * F.max(place - low)).alias(name))
    return placed.groupBy(*keys).agg(*columns) if keys else placed.agg(*columns)


def numeric_statistics(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """count, total, mean, min, median, p90, p95, p99 and max of the non-null values."""
    keys = list(group)
    v = F.col(value).cast("double")
    basic = df.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    points = exact_percentiles(df, value, STATISTIC_POINTS, STATISTIC_NAMES, keys)
    joined = join_groups(basic, points, keys)
    return joined.select(*keys, "count", "total", "mean", "min", *STATISTIC_NAMES, "max")


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on grouping keys that may be null; without keys both sides are one row."""
    if not keys:
        return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = condition[0]
    for more in condition[1:]:
        on = on & more
    return left.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def distribution(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """min, median, p90, p95, p99 and max."""
    return exact_percentiles(df, value, DISTRIBUTION_POINTS, DISTRIBUTION_NAMES, group)


# ---------------------------------------------------------------- roll-ups of results


def stage_rows(results: DataFrame) -> DataFrame:
    """One row per record and stage with the scalar diagnostics."""
    stages = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(f"diagnostics.{s}").alias("d")) for s in ("extraction", "grounding")]
    )
    names = ("attempted", "prompt_tokens", "generated_tokens", "wall_seconds", "finish_reason", "truncated",
             "json_valid", "schema_valid", "model_error")
    return results.select(F.explode(stages).alias("s")).select(
        F.col("s.stage").alias("stage"), *[F.col(f"s.d.{n}").alias(n) for n in names]
    )


def stage_rollup(rows: DataFrame, group: Sequence[str] = ("stage",)) -> DataFrame:
    """Counts and rates per stage. Rates are over attempted calls and null without any."""
    tried = F.coalesce("attempted", F.lit(False))

    def count(condition: Column) -> Column:
        return F.count_if(tried & F.coalesce(condition, F.lit(False)))

    counted = rows.groupBy(*group).agg(
        F.count_if(tried).alias("attempted_records"),
        F.count_if(~tried).alias("skipped_records"),
        count(F.col("truncated")).alias("truncated_records"),
        count(~F.col("json_valid")).alias("json_failures"),
        count(~F.col("schema_valid")).alias("schema_failures"),
        count(F.col("json_valid").isNotNull()).alias("json_evaluated_records"),
        count(F.col("schema_valid").isNotNull()).alias("schema_evaluated_records"),
        count(F.col("model_error").isNotNull()).alias("model_errors"),
        F.coalesce(F.sum(F.when(tried, F.col("wall_seconds"))), F.lit(0.0)).alias("wall_seconds"),
        F.coalesce(F.sum(F.when(tried, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens_total"),
        F.coalesce(F.sum(F.when(tried, F.col("generated_tokens"))), F.lit(0)).alias("generated_tokens_total"),
    )

    def rate(name: str) -> Column:
        return F.try_divide(F.col(name), F.col("attempted_records"))

    return counted.select(
        "*",
        rate("truncated_records").alias("truncation_rate"),
        rate("json_failures").alias("json_failure_rate"),
        rate("schema_failures").alias("schema_failure_rate"),
        F.try_divide("attempted_records", "wall_seconds").alias("records_per_second"),
    )


def finish_reasons(rows: DataFrame, group: Sequence[str] = ("stage",)) -> DataFrame:
    """Attempted calls per finish reason."""
    return (
        rows.filter(F.coalesce("attempted", F.lit(False)) & F.col("finish_reason").isNotNull())
        .groupBy(*group, "finish_reason")
        .agg(F.count("*").alias("calls"))
    )


def stage_token_statistics(rows: DataFrame, column: str, group: Sequence[str] = ("stage",)) -> DataFrame:
    """Statistics of a token count over attempted calls."""
    return numeric_statistics(rows.filter(F.coalesce("attempted", F.lit(False))), column, group)


def record_rollup(results: DataFrame) -> DataFrame:
    """Processed, completed and failed records, and annotation counts, in one pass."""
    statuses = F.transform("concepts", lambda c: c["annotation"]["status"])

    def number(value: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(statuses, lambda s: s == value))), F.lit(0))

    counted = results.agg(
        F.count("*").alias("processed_records"),
        F.count_if(F.col("status") == "completed").alias("completed_records"),
        F.coalesce(F.sum(F.size("concepts")), F.lit(0)).alias("total_concepts"),
        number("matched").alias("matched_annotations"),
        number("unresolved").alias("unresolved_annotations"),
        F.coalesce(F.sum("diagnostics.retrieval_seconds"), F.lit(0.0)).alias("retrieval_wall_seconds"),
        F.coalesce(F.sum("diagnostics.record_wall_seconds"), F.lit(0.0)).alias("record_wall_seconds"),
        *[
            F.coalesce(
                F.sum(
                    F.coalesce(f"diagnostics.extraction.{name}", F.lit(0))
                    + F.coalesce(f"diagnostics.grounding.{name}", F.lit(0))
                ),
                F.lit(0),
            ).alias(f"total_{name}")
            for name in ("prompt_tokens", "generated_tokens")
        ],
    )
    return counted.select(
        "*",
        (F.col("processed_records") - F.col("completed_records")).alias("failed_records"),
        (F.col("total_concepts") - F.col("matched_annotations") - F.col("unresolved_annotations")).alias(
            "concepts_without_annotations"
        ),
    )


def failures_by_stage(results: DataFrame) -> DataFrame:
    return results.filter(F.col("failed_stage").isNotNull()).groupBy("failed_stage").agg(F.count("*").alias("records"))


def concepts_per_record(results: DataFrame) -> DataFrame:
    return results.select("rec_id", F.size("concepts").alias("concepts"))


def run_summary(results: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row with the whole summary of a run.

    The columns of ``record_rollup``, both rates of ``throughput`` over the records' wall seconds,
    ``failures_by_stage`` (map), ``concepts_per_record`` (statistics), ``stages`` (map from stage to its
    roll-up, ``finish_reasons`` and token statistics) and, with the one row of ``provenance``, ``sample_input``.
    """
    # Read several times below: two rows of numbers a record, and its count of concepts.
    rows = write_stage(stage_rows(results), "summary-stages")
    counts = write_stage(concepts_per_record(results), "summary-concepts")
    reasons = finish_reasons(rows).groupBy("stage").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("finish_reason", "calls")))).alias("finish_reasons")
    )
    stages = stage_rollup(rows).join(reasons, "stage", "left")
    for column in ("prompt_tokens", "generated_tokens"):
        found = stage_token_statistics(rows, column)
        numbers = F.struct(*[c for c in found.columns if c != "stage"]).alias(f"{column}_statistics")
        stages = stages.join(found.select("stage", numbers), "stage", "left")
    block = F.struct(*[c for c in stages.columns if c != "stage"])
    seconds = F.nullif("record_wall_seconds", F.lit(0.0))
    concepts = numeric_statistics(counts, "concepts")
    # Every part below is one row; stages and their failures are a handful.
    parts = [
        record_rollup(results).select("*", *throughput(F.col("processed_records"), F.col("completed_records"), seconds)),
        failures_by_stage(results).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("failed_stage", "records")))).alias("failures_by_stage")
        ),
        concepts.select(F.struct(*concepts.columns).alias("concepts_per_record")),
        stages.agg(F.map_from_entries(F.collect_list(F.struct(F.col("stage"), block.alias("block")))).alias("stages")),
    ]
    if provenance is not None:
        parts.append(provenance.select(F.struct(*provenance.columns).alias("sample_input")))
    summary = parts[0]
    for part in parts[1:]:
        summary = join_groups(summary, part, ())
    return summary


def annotation_rollup(annotations: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts over one row per concept with a nullable ``status``."""
    return annotations.groupBy(*group).agg(
        F.count_if(F.col("status") == "matched").alias("matched_annotations"),
        F.count_if(F.col("status") == "unresolved").alias("unresolved_annotations"),
        F.count_if(F.col("status").isNull()).alias("concepts_without_annotations"),
    )


def throughput(records: Column, completed: Column, seconds: Column) -> list[Column]:
    """Records and completed records per second; null at zero time."""
    return [
        F.try_divide(records, seconds).alias("records_per_second"),
        F.try_divide(completed, seconds).alias("completed_records_per_second"),
    ]


def id_frequency(annotations: DataFrame) -> DataFrame:
    """Matched IDs by how often they occur."""
    return (
        annotations.filter(F.col("status") == "matched").groupBy("ontology_id").agg(F.count("*").alias("annotations"))
    )


def result_counts(results: DataFrame, field: str = "isolation_source") -> DataFrame:
    """(measure, value, n) over enrichment results, in one pass.

    Concepts by ``status`` (null without an annotation), matched concepts by ``ontology_id``, and records by the value
    of metadata key ``field``, which is left out where a record has none. Only counts pass the shuffle.
    """
    def counted(measure: str, value: Column) -> Column:
        return F.struct(F.lit(measure).alias("measure"), value.cast("string").alias("value"))

    notes = F.transform("concepts", lambda c: c["annotation"])
    matched = F.filter(notes, lambda a: F.coalesce(a["status"] == "matched", F.lit(False)))
    own = F.try_element_at("metadata", F.lit(field))
    values = F.concat(
        F.transform(notes, lambda a: counted("status", a["status"])),
        F.transform(matched, lambda a: counted("ontology_id", a["ontology_id"])),
        F.array_compact(F.array(F.when(own.isNotNull(), counted(field, own)))),
    )
    return results.select(F.inline(values)).groupBy("measure", "value").agg(F.count("*").alias("n"))


def source_value_mismatches(results: DataFrame) -> DataFrame:
    """Concepts whose raw value is not the metadata value of their source field; expected to be empty.

    (rec_id, concept_index, source_field, raw_value, source_value); a missing field or value counts as different from any text.
    """
    rows = results.select("rec_id", "metadata", F.posexplode("concepts").alias("concept_index", "c"))
    found = rows.select(
        "rec_id", "concept_index", F.col("c.source_field").alias("source_field"), F.col("c.raw_value").alias("raw_value"),
        F.try_element_at("metadata", F.col("c.source_field")).alias("source_value"),
    )
    return found.filter(~F.col("raw_value").eqNullSafe(F.col("source_value")))


def run_throughput(calls: DataFrame) -> DataFrame:
    """Tokens, rates and length stops per run over one row per call."""
    counted = calls.groupBy("run_id").agg(
        F.count("*").alias("records"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("generated_tokens").alias("generated_tokens"),
        F.max("run_seconds").alias("wall_seconds"),
        F.count_if(F.col("finish_reason") == "length").alias("length_stops"),
    )
    seconds = F.col("wall_seconds")
    return counted.select(
        "*",
        F.try_divide("generated_tokens", seconds).alias("generated_tokens_per_second"),
        F.try_divide(F.col("prompt_tokens") + F.col("generated_tokens"), seconds).alias("total_tokens_per_second"),
        F.try_divide("records", seconds).alias("records_per_second"),
    )


def telemetry_rollup(samples: DataFrame, group: Sequence[str] = ("run_id", "phase")) -> DataFrame:
    """Utilisation and memory of a telemetry table."""
    keys = list(group)
    basic = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg("utilization_percent").alias("utilization_mean"),
        F.min("utilization_percent").alias("utilization_min"),
        F.max("utilization_percent").alias("utilization_peak"),
        F.max("used_mib").alias("peak_used_mib"),
    )
    median = exact_percentiles(samples, "utilization_percent", (0.5,), ("utilization_median",), keys)
    return join_groups(basic, median, keys)


def token_cap_suggestion(p99: Column) -> Column:
    """p99 with a quarter of headroom, rounded up to a multiple of 16."""
    return (F.ceil(p99 * 1.25 / 16) * 16).cast("long")


def metadata_lost(records: DataFrame, results: DataFrame) -> DataFrame:
    """Record IDs whose entries differ between input and results; expected to be empty."""
    def rows(df: DataFrame) -> DataFrame:
        entries = F.array_sort(F.map_entries("metadata"))
        return df.select("rec_id", F.md5(F.to_json(entries)).alias("content"))

    before, after = rows(records), rows(results).withColumnRenamed("content", "content_after")
    return before.join(after, "rec_id", "full").filter(~F.col("content").eqNullSafe(F.col("content_after"))).select("rec_id")
