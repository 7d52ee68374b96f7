"""Source positions and reproducible uniform samples without replacement."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from urllib.parse import unquote

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.operators.canonical import at_least_fields, canonicalise
from termloom.plans.staging import broadcast_if_small, shuffle_width, write_stage

# Hexadecimal digits of a hash range; at most 65,536 counts reach the driver.
# So many rows around the end of a sample may be sorted in one task.
SORTED_ROWS = 200_000


def dense_number(df: DataFrame, order: Sequence[str], name: str, stage: str = "numbered") -> DataFrame:
    """0-based number of every row in the order of ``order``, without a single-task sort.

    Rows are range-partitioned and written with their partition number. A prefix sum over one
    count per partition then turns the numbers inside each partition into global ones.
    """
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("__part", F.spark_partition_id())
    ranged = write_stage(ranged, stage)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("__part")
        .count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__within", F.row_number().over(within) - 1)
    # One row per shuffle partition, so the size of this side is set by configuration.
    return numbered.join(F.broadcast(starts), "__part").select(
        *df.columns, (F.col("__start") + F.col("__within")).cast("long").alias(name)
    )


def source_position(spark: SparkSession, path: str | Sequence[str], name: str = "pos") -> DataFrame:
    """All Parquet rows with their global row number over the files in path order.

    The number depends neither on batches nor on row groups. Row counts come from the file
    footers; the table of starts has one row per file and is broadcast under the size limit.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.parquet(*paths)
    located = rows.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    files, starts, _ = _file_starts(spark, paths)
    table = spark.createDataFrame(list(zip(files, starts.tolist())), "__file string, __start long")
    size = sum(map(len, files)) + 64 * len(files)
    return located.join(broadcast_if_small(table, size), "__file").select(
        *rows.columns, (F.col("__start") + F.col("__row")).cast("long").alias(name)
    )


def sample_key(seed: int, *key_columns: str) -> Column:
    """Hexadecimal md5 of seed and row key: the same order in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_columns]))


# The hash order is cut by its first 52 bits.
_HASH_HEX = 13


def _cut(share: float) -> str:
    """The smallest hash text that lies above ``share`` of all hashes."""
    return format(min(max(int(share * 16**_HASH_HEX), 0), 16**_HASH_HEX - 1), f"0{_HASH_HEX}x") if share < 1 else "g"


def _cuts(keyed: DataFrame, n: int, total: int) -> tuple[str, str, int, int]:
    """(low, high, rows below low, rows below high): hash texts around the n-th smallest hash.

    Hashes are even, so the number of rows below a hash strays from its mean by few roots of it; the margin is
    seven of them, and doubles in the rare case, such as one key on many rows, that it does not hold.
    """
    margin = 7 * math.sqrt(n) + 30
    while True:
        low, high = _cut((n - margin) / total), _cut((n + margin) / total)
        below, upto = keyed.agg(F.count_if(F.col("__hash") < low), F.count_if(F.col("__hash") < high)).first()
        if below <= n <= upto or (margin > total and upto >= n):
            return (low, high, below, upto) if below <= n else ("", high, 0, upto)
        margin *= 2


def hash_sample(df: DataFrame, n: int, seed: int, key_columns: Sequence[str]) -> DataFrame:
    """Uniform sample of ``n`` rows: the ``n`` smallest hashes of the row keys, in no order.

    The row count gives two hashes between which the n-th smallest lies: all rows below the lower one
    are kept, and of the few rows between them the smallest. So a sample takes the row count, one
    pass over the keys, and one over the rows. Rows between the two that are many, as one key may be on a great part
    of all rows, are numbered over range partitions.
    """
    if n < 0:
        raise ValueError("The sample size must not be negative")
    total = df.count()
    if total <= n:
        return df
    if n == 0:
        return df.limit(0)
    keyed = df.withColumn("__hash", sample_key(seed, *key_columns))
    low, high, below, upto = _cuts(keyed, n, total)
    between = keyed.filter((F.col("__hash") >= low) & (F.col("__hash") < high))
    order = ["__hash", *key_columns]
    if upto - below <= SORTED_ROWS:
        part = between.orderBy(*order).limit(n - below)
    else:
        part = dense_number(between, order, "__no").filter(F.col("__no") < n - below).drop("__no")
    return keyed.filter(F.col("__hash") < low).union(part).drop("__hash")


def _file_starts(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], np.ndarray, int]:
    """Files in path order, the global number of the first row of each, and the row total.

    One row per file reaches the driver, which lists the files of the table anyway.
    """
    located = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file"))
    counts = sorted(tuple(r) for r in located.groupBy("file").count().collect())
    ends = np.cumsum([0] + [rows for _, rows in counts], dtype="int64")
    return [file for file, _ in counts], ends[:-1], int(ends[-1])


def position_sample(
    spark: SparkSession, path: str | Sequence[str], n: int, seed: int = 12345, name: str = "pos"
) -> DataFrame:
    """The rows at ``n`` positions drawn from the row count alone, in position order.

    Row counts come from the footers. Only the files that hold a drawn row are read, and those as a
    whole: Spark does not skip row groups by row number. The draw is made in the driver, so ``n`` is
    a number of rows that a driver can hold.
    """
    if n < 0:
        raise ValueError("The sample size must not be negative")
    paths = [path] if isinstance(path, str) else list(path)
    files, starts, total = _file_starts(spark, paths)
    drawn = np.array(sorted(random.Random(seed).sample(range(total), min(n, total))), dtype="int64")
    at = np.searchsorted(starts, drawn, "right") - 1
    picked = spark.createDataFrame(
        [(files[i], row, pos) for i, row, pos in zip(at.tolist(), (drawn - starts[at]).tolist(), drawn.tolist())],
        f"__file string, __row long, `{name}` long",
    )
    rows = spark.read.parquet(*([unquote(files[i]) for i in np.unique(at)] or paths))
    located = rows.withColumn("__file", F.col("_metadata.file_path")).withColumn("__row", F.col("_metadata.row_index"))
    # The size of the drawn side is known when the query is planned, so the planner decides on a broadcast.
    return located.join(picked, ["__file", "__row"]).select(*rows.columns, name).orderBy(name)


def source_sample(
    spark: SparkSession, path: str | Sequence[str], n: int, seed: int, key_columns: Sequence[str], name: str = "pos"
) -> DataFrame:
    """The rows of ``hash_sample`` with their position in the source, in that order."""
    return hash_sample(source_position(spark, path, name), n, seed, key_columns).orderBy(name)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows: by file, split and place for a table read from files, else by partition and place."""
    place = [F.monotonically_increasing_id().alias("__place")]
    try:
        keyed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), *place)
    except AnalysisException:
        keyed = df.select("*", *place)
    order = [c for c in ("__file", "__split", "__place") if c in keyed.columns]
    return keyed.orderBy(*order).limit(n).drop(*order)


def sample_records(
    df: DataFrame, n: int, seed: int, key_columns: Sequence[str], min_nonempty_fields: int = 0
) -> DataFrame:
    """Sample rows, canonicalised. Without a threshold only the drawn rows are canonicalised."""
    if min_nonempty_fields:
        records = canonicalise(df, keep=key_columns, columns=df.columns)
        return hash_sample(at_least_fields(records, min_nonempty_fields), n, seed, key_columns)
    return canonicalise(hash_sample(df, n, seed, key_columns), keep=key_columns, columns=df.columns)


def sample_provenance(
    population: DataFrame,
    n: int,
    seed: int,
    input_format: str,
    min_nonempty_fields: int = 0,
    method: str = "smallest_hash",
    positions: DataFrame | None = None,
) -> DataFrame:
    """One row: how the sample was drawn and from how many records.

    ``population`` holds the canonical records before the threshold. ``positions``, one column of the
    drawn rows, adds their ``source_row_indices`` in order; it is as large as the sample.
    """
    eligible = F.size("metadata") >= min_nonempty_fields
    counted = population.agg(
        F.count("*").alias("population_records"), F.count_if(eligible).alias("eligible_records")
    )
    given = ()
    if positions is not None:
        listed = positions.agg(F.array_sort(F.collect_list(positions.columns[0])).alias("source_row_indices"))
        counted = counted.withColumn("__one", F.lit(1)).join(listed.withColumn("__one", F.lit(1)), "__one")
        given = ("source_row_indices",)
    return counted.select(
        F.lit(method).alias("method"),
        "population_records",
        "eligible_records",
        F.least(F.lit(n).cast("long"), F.col("eligible_records")).alias("sampled_records"),
        F.lit(input_format).alias("input_format"),
        F.lit(n).cast("long").alias("requested_records"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(min_nonempty_fields).cast("long").alias("min_nonempty_fields"),
        *given,
    )
