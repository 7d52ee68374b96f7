"""Tables written between jobs, and the size checks behind every broadcast."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may take this many bytes in its in-memory form; beyond it joins shuffle.
BROADCAST_BYTES = 256 * 1024 * 1024


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session of one process may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="termloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# The folder of the run that this thread is in.
_run: ContextVar[str | None] = ContextVar("stage_run", default=None)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def stage_run(spark: SparkSession, of: str | None = None) -> Iterator[str]:
    """Tables staged inside the block lie in one folder, which goes when the block ends, also by an error.

    Results must be written or collected inside the block; tables staged with a path of their own, such as an index,
    stay. ``of`` names what the run makes, such as its output: a run that is killed leaves its folder, and
    the next run of the same name removes it first. So two runs of one name must not overlap.
    """
    mark = hashlib.md5(of.encode()).hexdigest() if of else uuid.uuid4().hex
    folder = f"{staging_folder(spark).rstrip('/')}/run-{mark}"
    _remove(spark, folder)
    before = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(before)
        _remove(spark, folder)


def write_stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later jobs do not repeat its lineage."""
    spark = df.sparkSession
    target = path or f"{(_run.get() or staging_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def broadcast_if_small(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size in bytes is under the limit."""
    return F.broadcast(df) if size <= limit else df


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: Column, how: str, salts: int = 16) -> DataFrame:
    """Join to a table with one row per key that is too large to broadcast, where keys of ``rows`` may be hot.

    Every row of ``table`` is repeated for each salt, and ``rows`` are dealt over the salts by a hash of ``by``.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the configured number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition by ``columns`` into a fixed number of partitions.

    For rows that grow a lot after the shuffle, such as texts turned into grams: a fixed number
    keeps adaptive execution from merging partitions that only look small before they grow.
    The number differs from the configured one, because Spark drops a repartition that equals the
    partitioning below it and would then merge the partitions that remain.
    """
    return df.repartition(2 * shuffle_width(df.sparkSession), *columns)
