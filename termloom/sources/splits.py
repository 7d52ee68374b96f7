"""State at the start of every split of a text file, composed over the splits before it.

A reader that must know where it is in a file, inside a quote or a comment, cannot start in the middle. Here
every split is scanned once for every state it might start in, which gives its transition; the transitions
of a file are composed in order, and a second pass scans each split from its true state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.plans.staging import write_stage

# From a state and a piece to the state after it and what it adds to each count.
Scan = Callable[[str, str], tuple[str, list[int]]]


def split_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(source_file, split, value): the pieces of text files between separators; a split's pieces stay in order."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """(source_file, split) and the other columns of its rows, as a stream; the rows of a split follow one another."""
    rows = ((file, split, row) for b in batches for file, split, *row in zip(*(c.to_pylist() for c in b.columns)))
    held = next(rows, None)
    while held is not None:
        here = held[:2]

        def stream() -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[:2] == here:
                row, held = held[2], next(rows, None)
                yield row

        pieces = stream()
        yield here, pieces
        for _ in pieces:
            pass


def start_states(pieces: DataFrame, separator: str, states: tuple[str, ...], scan: Scan, n_counts: int) -> DataFrame:
    """(source_file, split, state, counts, is_last): where each split starts.

    The first split of a file starts in the first of ``states`` with counts of 0. ``scan`` gets each piece
    with the separator before it, which only the first piece of a file has not. A split gives one row, and
    the rows of a file, one for each stretch that Spark cuts it into, are composed in one task.
    """
    first = states[0]

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), rows in runs(batches):
            begin = (first,) if split == 0 else states
            at = {s: (s, [0] * n_counts) for s in begin}
            for n, (value,) in enumerate(rows):
                value = separator + value if n or split else value
                done = {s: scan(s, value) for s in {state for state, _ in at.values()}}
                at = {s: (done[now][0], [a + b for a, b in zip(counts, done[now][1])]) for s, (now, counts) in at.items()}
            kept = [(s, end, counts) for s, (end, counts) in at.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([split], pa.int64()),
                 pa.array([[(s, {"state": e, "counts": c}) for s, e, c in kept]], pa.map_(pa.string(), pa.struct([("state", pa.string()), ("counts", pa.list_(pa.int64()))])))],
                ["source_file", "split", "moves"],
            )

    schema = "source_file string, split long, moves map<string,struct<state:string,counts:array<long>>>"
    moves = write_stage(pieces.mapInArrow(transitions, schema), "transitions")
    kinds = "source_file string, split long, state string, counts array<long>, is_last boolean"

    def compose(rows: pa.Table) -> pa.Table:
        state, counts, out = first, [0] * n_counts, []
        listed = sorted(zip(rows["source_file"].to_pylist(), rows["split"].to_pylist(), map(dict, rows["moves"].to_pylist())), key=lambda r: r[1])
        for file, split, moves in listed:
            out.append((file, split, state, counts, split == listed[-1][1]))
            state, counts = moves[state]["state"], [a + b for a, b in zip(counts, moves[state]["counts"])]
        names = [k.split(" ")[0] for k in kinds.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return write_stage(moves.groupBy("source_file").applyInArrow(compose, kinds), "starts")


def stitched(parts: DataFrame, *first: str) -> DataFrame:
    """Whole texts of records that lie in several splits: at most two parts of each split meet.

    ``parts`` has (source_file, split, n, begins, text); a record has the place and the columns ``first`` of its first part.
    """
    number = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("source_file").orderBy("split", "n"))
    part = F.struct("split", "n", *first, "text")
    found = parts.withColumn("record", number).groupBy("source_file", "record").agg(F.sort_array(F.collect_list(part)).alias("p"))
    head = F.get("p", F.lit(0))
    return found.select("source_file", *[head[c].alias(c) for c in ("split", "n", *first)], F.array_join("p.text", "").alias("text"))
