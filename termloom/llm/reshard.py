"""Resharding by minimum-cost flow: the fewest bytes move, and only changed shards are written."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import fresh

# Bytes of a row besides its text.
ROW_BYTES = 16
# Rows of one old shard and size class are numbered in so many independent parts.
PARTS = 256


class Flow:
    """Minimum-cost flow by shortest augmenting paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self._arcs: list[list[list]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: float) -> list:
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self._arcs[a].append(there)
        self._arcs[b].append(back)
        return there

    def run(self, source: int, sink: int) -> None:
        n = len(self._arcs)
        height = [float("inf")] * n
        height[source] = 0.0
        for _ in range(n):  # costs may be negative at first
            changed = False
            for a in range(n):
                for b, room, cost, _ in self._arcs[a]:
                    if room and height[a] + cost < height[b] - 1e-9:
                        height[b], changed = height[a] + cost, True
            if not changed:
                break
        while True:
            far, into = [float("inf")] * n, [None] * n
            far[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for arc in self._arcs[a]:
                    b, room, cost, _ = arc
                    if room:
                        to = d + max(0.0, cost + height[a] - height[b])
                        if to < far[b] - 1e-9:
                            far[b], into[b] = to, arc
                            heapq.heappush(heap, (to, b))
            if into[sink] is None:
                return
            for a in range(n):
                if far[a] < float("inf"):
                    height[a] += far[a]
            path, at = [], sink
            while at != source:
                path.append(into[at])
                at = into[at][3][0]
            amount = min(arc[1] for arc in path)
            for arc in path:
                arc[1] -= amount
                arc[3][1] += amount


def plan_transfers(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple]:
    """(old shard, size class, first rank, end rank, new shard, first slot) of every block transfer.

    ``blocks`` are (old shard, size class, rows, bytes). The new shards take equal row counts, the
    remainder one more each. A row that keeps its shard number costs nothing, any other its bytes,
    taken as the mean of its block, so that small rows move first. Which shards take one row more
    is part of the solution. Flow nodes and arcs grow with shards and size classes, not with rows.
    """
    blocks = sorted(blocks)
    total = sum(b[2] for b in blocks)
    floor, extra = divmod(total, shards)
    dear = 2.0 * (sum(b[3] for b in blocks) + 1)
    source, pool, first = 0, 1, 2
    sink = first + shards + len(blocks)
    flow = Flow(sink + 1)
    stay, move = {}, {}
    for i, (old, _, rows, size) in enumerate(blocks):
        node = first + shards + i
        flow.arc(source, node, rows, 0.0)
        if old < shards:
            stay[i] = flow.arc(node, first + old, rows, 0.0)
        move[i] = flow.arc(node, pool, rows, size / rows)
    given = []
    for shard in range(shards):
        given.append(flow.arc(pool, first + shard, total, 0.0))
        flow.arc(first + shard, sink, floor, -dear)  # the floor comes first
        flow.arc(first + shard, sink, int(extra > 0), 0.0)
    flow.run(source, sink)
    wanted = [[shard, arc[3][1]] for shard, arc in enumerate(given) if arc[3][1]]
    found, slots = [], defaultdict(int)

    def send(block: tuple, start: int, rows: int, shard: int) -> int:
        if rows:
            found.append((block[0], block[1], start, start + rows, shard, slots[shard]))
            slots[shard] += rows
        return start + rows

    for i, block in enumerate(blocks):
        at = send(block, 0, stay[i][3][1] if i in stay else 0, block[0])
        leave = move[i][3][1]
        while leave:
            rows = min(leave, wanted[0][1])
            at = send(block, at, rows, wanted[0][0])
            leave -= rows
            wanted[0][1] -= rows
            if not wanted[0][1]:
                wanted.pop(0)
    return found


def reshard(
    docs: DataFrame,
    old_shard: Column,
    shards: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """A new shard and slot for every row, moving the fewest bytes from the old shards.

    The law is ``rows``: row counts of the new shards differ by one at most. Result: the id, ``size``
    (UTF-8 bytes of the text plus 16), ``text_crc32``, ``old_shard``, ``shard``, ``slot`` (gapless from
    0 in each shard) and the columns named in ``carry``.

    Method: rows are counted by old shard and size class (powers of two); the driver gets that table
    (at most 63 rows per old shard) and solves the flow between old and new shards. Rows then find
    their place by their rank in (old shard, size class), which is the number of rows in the parts
    before plus a row number in a small part, so no shard is ever sorted in one task.

    A null text has no bytes; a null id counts as a value like any other; equal rows are told apart
    only by their slots; an empty table gives no rows. Old shard numbers must not be negative or null.
    """
    size, crc, old, kind, part, rank = fresh(docs, "size", "text_crc32", "old_shard", "kind", "part", "rank")
    text = F.coalesce(F.col(text_column), F.lit(""))
    sized = docs.select(
        id_column,
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias(size),
        F.crc32(text.cast("binary")).alias(crc),
        old_shard.cast("int").alias(old),
        *carry,
    ).withColumns({kind: F.floor(F.log2(size)).cast("int"), part: F.pmod(F.xxhash64(id_column, crc), F.lit(PARTS)).cast("int")})
    counts = sized.groupBy(old, kind, part).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    spark = docs.sparkSession
    blocks = [tuple(r) for r in counts.groupBy(old, kind).agg(F.sum("n"), F.sum("b")).collect()]
    transfers = spark.createDataFrame(
        plan_transfers(blocks, shards), "`to_old` int, `to_kind` int, `lo` long, `hi` long, `shard` int, `base` long"
    )
    before = Window.partitionBy(old, kind).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(old).alias("s_old"), F.col(kind).alias("s_kind"), F.col(part).alias("s_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s_start"),
    )
    within = Window.partitionBy(old, kind, part).orderBy(size, id_column, crc)
    ranked = sized.withColumn(rank, F.row_number().over(within) - 1)
    ranked = ranked.join(
        starts, [ranked[old] == starts.s_old, ranked[kind] == starts.s_kind, ranked[part] == starts.s_part]
    ).withColumn(rank, F.col(rank) + F.col("s_start"))
    # At most one row per block and new shard, so this side is bounded by the number of shards.
    placed = ranked.join(
        F.broadcast(transfers),
        [ranked[old] == transfers.to_old, ranked[kind] == transfers.to_kind,
         F.col(rank) >= transfers.lo, F.col(rank) < transfers.hi],
    )
    return placed.select(
        id_column, F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.col(old).alias("old_shard"),
        transfers.shard, (transfers.base + F.col(rank) - transfers.lo).alias("slot"), *carry,
    )


def rewrite_affected(placed: DataFrame, path: str) -> None:
    """Write the shards that gained or lost a row; the files of all others stay as they are.

    ``placed`` is the result of ``reshard`` with the columns to store in ``carry``. Each shard becomes
    one folder ``shard=N`` whose files follow the slots.
    """
    moved = F.col("old_shard") != F.col("shard")
    touched = placed.filter(moved).select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    # At most one row per shard.
    changed = placed.join(F.broadcast(touched), "shard", "left_semi")
    changed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode(
        "errorifexists"
    ).parquet(path)
