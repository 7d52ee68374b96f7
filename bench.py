"""Headline timings. Prints one JSON line; reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

HEADLINES = (
    "canonicalise_orders",
    "hash_sample",
    "position_sample",
    "char_ngrams",
    "build_postings",
    "retrieve_top_k",
    "check_responses",
    "reconstruct_annotations",
    "validate_selected_ids",
    "enrich",
    "numeric_statistics",
    "stage_rollup",
    "record_rollup",
    "audit_response",
    "agreement",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("termloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from termloom.catalog import all_queries

    queries = all_queries()
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    run(queries["select_fields"](spark, folder))  # the first job pays for start-up
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        run(queries[name](spark, folder))
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
