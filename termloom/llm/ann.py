"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from termloom.llm.common import join_groups
from termloom.plans.staging import write_stage

TABLES = 4
FUNCTIONS = 4
WIDTH = 1.2
PROBES = 40
SEED = 29
# Vectors and queries of one task group at most; larger buckets are cut into a grid of groups.
GROUP_VECTORS = 4096
GROUP_QUERIES = 1024


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundary ranks in order of the expected squared distance to what they cross.

    Rank j is the j-th nearest of the 2 x ``functions`` cell boundaries of a query; its expected squared
    distance is known for random projections. Sets grow from a heap by shifting or extending the last
    rank, and a set that crosses both sides of one function is left out.
    """
    m = functions
    ranks = np.arange(1, 2 * m + 1)
    mirrored = 2 * m + 1 - ranks
    near = ranks * (ranks + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - mirrored / (m + 1) + mirrored * (mirrored + 1) / (4 * (m + 1) * (m + 2))
    cost = np.where(ranks <= m, near, far)
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - c not in chosen for c in chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return found


class Tables:
    """Random projections of all hash tables for one dimension."""

    def __init__(self, dimension: int, tables: int, functions: int, width: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dimension])
        self.width = width
        self._axes = rng.standard_normal((tables, dimension, functions))
        self._shifts = rng.uniform(0, width, (tables, 1, functions))
        self._mix = rng.integers(0, 2**62, functions) * 2 + 1

    def _cells(self, unit: np.ndarray) -> np.ndarray:
        return (unit[None] @ self._axes + self._shifts) / self.width

    def _code(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self._mix).sum(axis=-1)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(tables, rows): the bucket of every row in every table."""
        return self._code(np.floor(self._cells(unit)))

    def probes(self, unit: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
        """(tables, rows, probes): buckets to visit, the most promising first."""
        cells = self._cells(unit)
        floor = np.floor(cells)
        inside = cells - floor
        m = cells.shape[-1]
        order = np.concatenate([inside, 1 - inside], axis=-1).argsort(axis=-1)
        found = []
        for chosen in sets:
            moved = floor.copy()
            for rank in chosen:
                edge = order[..., rank : rank + 1]
                step = np.where(edge < m, -1.0, 1.0)
                np.put_along_axis(moved, edge % m, np.take_along_axis(moved, edge % m, -1) + step, -1)
            found.append(self._code(moved))
        return np.stack(found, axis=-1)


def _usable(vector: Column) -> Column:
    """Vectors with components, all finite and not all zero."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(as_double, lambda x: x != 0), F.lit(False))


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: no square under- or overflows."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True))[1])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix) of the vectors of each dimension in a batch of (row, vector)."""
    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, int)
    flat, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()[:-1]
    for dimension in np.unique(sizes):
        at = np.flatnonzero(sizes == dimension)
        yield at, flat[starts[at][:, None] + np.arange(dimension)]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tables: int = TABLES,
    functions: int = FUNCTIONS,
    width: float = WIDTH,
    probes: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` vectors of largest cosine found for every query.

    Candidates are all rows but the query's own. Score is the cosine of the original vectors in double
    precision; ties go to the smaller id. Only vectors of one dimension are compared.

    Method: unit vectors are hashed by ``functions`` p-stable functions in each of ``tables`` tables, and
    every row is in every table. A query visits its own bucket and the ``probes`` - 1 perturbed buckets
    that are most likely to hold near vectors, in that order of estimated success. The candidates of
    all tables are ranked by exact score; a visit returns at most ``k`` rows. Buckets are counted, and
    one with more vectors or visits than a group may hold is cut into a grid of groups. A query that
    found fewer than ``k`` is compared with all vectors, in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Every other row,
    repeated or without id, is a candidate of its own for every query but itself; null ids come last among ties. Rows
    that ask with one id are queries of their own, and a row without id may ask. An empty table or no query gives no rows.
    """
    sets = perturbations(functions, probes)
    vector = F.col(vector_column)
    if not isinstance(vectors.schema[vector_column].dataType.elementType, FloatType | DoubleType):
        vector = vector.cast("array<double>")
    usable = _numbered(
        vectors.filter(_usable(vector)).select(
            F.col(id_column).alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
        )
    )
    ids = usable.select("row", "id")

    def hashing(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Tables] = {}
            for batch in batches:
                for at, matrix in _rows(batch):
                    d = matrix.shape[1]
                    hasher = known.setdefault(d, None) or Tables(d, tables, functions, width, seed)
                    known[d] = hasher
                    unit = _scaled(matrix)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    codes = hasher.probes(unit, sets) if probing else hasher.codes(unit)[..., None]
                    for t in range(tables):
                        lists = codes[t]
                        numbers = batch.column(0).take(pa.array(at))
                        arrays = pa.ListArray.from_arrays(
                            pa.array(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32)), pa.array(lists.ravel())
                        )
                        yield pa.RecordBatch.from_arrays(
                            [numbers, batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), t * 65536 + d, np.int64)), arrays],
                            names=["row", "vector", "part", "codes"],
                        )

        return run

    shape = f"row bigint, vector {usable.schema['vector'].dataType.simpleString()}, part bigint, codes array<bigint>"
    hashed = usable.select("row", "vector").mapInArrow(hashing(False), shape)
    index = hashed.select("row", "vector", "part", F.get("codes", F.lit(0)).alias("code"))
    asked = usable.filter("asks").select("row", "vector").mapInArrow(hashing(True), shape)
    visits = asked.select("row", "vector", "part", F.explode(F.array_distinct("codes")).alias("code"))
    index, visits = write_stage(index, "index"), write_stage(visits, "visits")
    filled = index.groupBy("part", "code").agg(F.count("*").alias("n"))
    visited = visits.groupBy("part", "code").agg(F.count("*").alias("m"))
    grid = filled.join(visited, ["part", "code"]).select(
        "part", "code", F.ceil(F.col("n") / GROUP_VECTORS).cast("int").alias("a"), F.ceil(F.col("m") / GROUP_QUERIES).cast("int").alias("b")
    )
    grid = write_stage(grid, "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join_groups(index, grid, ["part", "code"]).filter("a is not null").select(
        "part", "code", F.pmod(F.xxhash64("row"), F.col("a")).cast("int").alias("x"), every("b").alias("y"), "row", "vector"
    )
    right = join_groups(visits, grid, ["part", "code"]).filter("a is not null").select(
        "part", "code", every("a").alias("x"), F.pmod(F.xxhash64("row"), F.col("b")).cast("int").alias("y"), "row", "vector"
    )
    by = ["part", "code", "x", "y"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda a, b: _best(a, b, k), _FOUND)
    found = write_stage(_top(pairs, k), "found")
    enough = found.filter(f"rank = {k}").select("query").distinct()
    short = usable.filter("asks").join(enough, F.col("row") == F.col("query"), "left_anti").select("row", "vector")
    rest = _top(_all_against(usable, short, k), k)
    done = found.join(enough, "query", "left_semi").unionByName(rest)
    asking = ids.withColumnsRenamed({"row": "query", "id": "query_id"})
    return done.join(ids, "row").join(asking, "query").select("query_id", "rank", F.col("id").alias(id_column), "score")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (id, vector, asks) with a number of their own as ``row``, which rises with the id, nulls last.

    It is given once, in the job that writes them, so that it is the same for every reader.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("vector"), F.col("asks")]
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    return write_stage(ranged.withColumn("row", F.monotonically_increasing_id()), "vectors")


_FOUND = "query bigint, row bigint, score double"


def _best(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of ``rows`` for each of ``asked``, as (query, row, score); the smaller row is first among ties."""
    empty = pd.DataFrame({"query": rows["row"][:0], "row": rows["row"][:0], "score": np.empty(0)})
    if not len(rows) or not len(asked):
        return empty
    ids, queries = rows["row"].to_numpy(), asked["row"].to_numpy()
    a, b = (np.stack(side["vector"].to_numpy()).astype(np.float64) for side in (rows, asked))
    scores = cosines(b, a)
    scores[queries[:, None] == ids[None, :]] = -np.inf
    out = []
    for i, query in enumerate(queries):
        best = scores[i]
        if len(best) > k:
            least = np.partition(best, len(best) - k)[len(best) - k]
            at = np.flatnonzero(best >= least)
        else:
            at = np.arange(len(best))
        at = at[np.isfinite(best[at])]
        at = at[np.lexsort((ids[at], -best[at]))][:k]
        out.append(pd.DataFrame({"query": query, "row": ids[at], "score": best[at]}))
    return pd.concat(out) if out else empty


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each summed in the order of components so that no block matters."""
    queries, rows = _scaled(queries), _scaled(rows)
    norm_q, norm_r = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
    dots = np.stack([(rows * q).sum(axis=1) for q in queries])
    return dots / (norm_q[:, None] * norm_r[None, :])


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "row")
    # A row may be met in several tables, always with the same score.
    ranked = pairs.groupBy("query", "row").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query", "rank", "row", "score")


def _all_against(usable: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """Exact answers of queries that found too few: blocks of vectors against blocks of these queries."""
    dimension = F.size("vector")
    short = short.withColumn("d", dimension)
    sizes = join_groups(short.groupBy("d").agg(F.count("*").alias("m")), usable.groupBy(dimension.alias("d")).agg(F.count("*").alias("n")), ["d"])
    grid = write_stage(
        sizes.select("d", F.ceil(F.col("n") / GROUP_VECTORS).cast("int").alias("a"), F.ceil(F.col("m") / GROUP_QUERIES).cast("int").alias("b")),
        "grid",
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = usable.select("row", "vector", dimension.alias("d")).join(F.broadcast(grid), "d").select(
        "d", F.pmod(F.xxhash64("row"), F.col("a")).cast("int").alias("x"), every("b").alias("y"), "row", "vector"
    )
    asked = short.join(F.broadcast(grid), "d").select(
        F.col("d").alias("d"), every("a").alias("x"), F.pmod(F.xxhash64("row"), F.col("b")).cast("int").alias("y"),
        F.col("row").alias("row"), F.col("vector").alias("vector"),
    )
    by = ["d", "x", "y"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(lambda a, b: _best(a, b, k), _FOUND)
