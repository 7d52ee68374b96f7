"""TSV records, with quoted cells that may hold tabs and line breaks, wherever Spark cuts the file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.fixed_values import TSV_NULL_WORDS
from termloom.operators.canonical import select_fields
from termloom.plans.staging import write_stage
from termloom.sources.splits import runs, split_pieces, start_states, stitched

# Where a line may begin: at a row, or inside a quoted cell of an earlier line.
STATES = ("row", "quoted")
# The rest of a quoted cell after its opening quote; a doubled quote stands for one.
_REST = re.compile(r'((?:[^"]++|"")*+)"([^\t]*+)')
_PARTS = "source_file string, split long, n long, line long, begins boolean, ends boolean, text string"
_ROWS = "source_file string, split long, n long, cells array<string>"


def cells_of(text: str) -> tuple[list[str], bool]:
    """(cells, open): the cells of a row, and whether its last one is quoted and not closed yet.

    A quote counts only at the start of a cell. What follows a closing quote belongs to the cell as it stands.
    """
    if '"' not in text:
        return text.split("\t"), False
    cells, at = [], 0
    while True:
        if text.startswith('"', at):
            if not (found := _REST.match(text, at + 1)):
                return [*cells, text[at + 1 :].replace('""', '"')], True
            cells.append(found[1].replace('""', '"') + found[2])
            end = found.end()
        else:
            end = text.find("\t", at)
            end = len(text) if end < 0 else end
            cells.append(text[at:end])
        if end == len(text):
            return cells, False
        at = end + 1


def scan(state: str, line: str) -> str:
    """The state after a line that begins in ``state``."""
    if '"' not in line:
        return state
    # Inside a quoted cell the line reads as if the cell had begun with it.
    return STATES[cells_of(line if state == "row" else '"' + line)[1]]


def _row_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the rows of each split without blank ones; those that reach over an end of it in parts."""
    names = [k.split(" ")[0] for k in _PARTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for (file, split), lines in runs(batches):
        out, size, n, state, held, begins, line, last = [], 0, 0, None, [], True, 0, False
        for at, (value, start, counts, last) in enumerate(lines):
            if state is None:
                state, line = start, counts[0]
                begins = state == "row"
            elif state == "row":
                begins, line = True, counts[0] + at
            # A split that begins inside a row owes it the line break before.
            held.append(value if begins and not held else "\n" + value)
            state = scan(state, value)
            if state == "row":
                text = "".join(held)
                held = []
                if not begins or text.strip(" \r"):
                    out.append((file, split, n, line + 1, begins, True, text))
                    size, n = size + len(text), n + 1
                if size > 4 << 20:
                    yield batch(out)
                    out, size = [], 0
        if held:
            if last:
                raise ValueError(f"{file} ends inside a quoted cell of the row that begins in line {line + 1}")
            out.append((file, split, n, line + 1, begins, False, "".join(held)))
        if out:
            yield batch(out)


def _cells(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells of every row but the header of each file; more cells than columns are an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, found = [], []
            for i, (file, split, n, line, text) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if split == 0 and n == 0:
                    continue
                cells, _ = cells_of(text.removesuffix("\r"))
                if len(cells) > width:
                    raise ValueError(f"{file}, line {line}: {len(cells)} cells under a header of {width}")
                kept.append(i)
                found.append(cells)
            places = b.select([0, 1, 2]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*places.columns, pa.array(found, pa.list_(pa.string()))], ["source_file", "split", "n", "cells"])

    return parse


def read_tsv_records(
    spark: SparkSession, path: str, fields: Sequence[str] | None = None, limit: int = 0
) -> DataFrame:
    """All-text TSV; empty cells and the usual null words read as empty text.

    Every file begins with a header line, of which that of the first file names the columns. A cell that begins with a
    quote may hold tabs, line breaks and doubled quotes. A row with fewer cells than columns ends in empty ones; one
    with more fails the job and names its file and line, and so does a file that ends inside a quoted cell. Rows end
    with a line feed, with or without a carriage return; blank lines are left out. ``limit`` keeps the first rows.

    Whether a split begins inside a quoted cell follows from all splits of the file before it, so a file is read twice.
    """
    header = spark.read.options(sep="\t", header=True, inferSchema=False, quote='"', escape='"').csv(path).columns
    pieces = split_pieces(spark, path, "\n")
    # The line break before a piece belongs to the piece; it never changes the state.
    starts = start_states(pieces, "", STATES, lambda state, line: (scan(state, line), [1]), 1)
    # One row for each split of the input, so the rows of a split stay in order beside it.
    placed = pieces.join(F.broadcast(starts), ["source_file", "split"])
    parts = placed.select("source_file", "split", "value", "state", "counts", "is_last").mapInArrow(_row_texts, _PARTS)
    columns = ["source_file", "split", "n", "line", "text"]
    if starts.filter("state = 'quoted'").isEmpty():
        texts = parts.select(columns)
    else:
        parts = write_stage(parts, "tsv-rows")
        whole = parts.filter("begins AND ends").select(columns)
        texts = whole.unionByName(stitched(parts.filter("NOT (begins AND ends)"), "line").select(columns))
    rows = texts.mapInArrow(_cells(len(header)), _ROWS)
    if limit:
        rows = rows.orderBy("source_file", "split", "n").limit(limit)
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)]
    chosen = select_fields(rows.select(*cells), fields or header)
    return chosen.select(
        *[F.when(F.col(f"`{c}`").isin(*TSV_NULL_WORDS), "").otherwise(F.col(f"`{c}`")).alias(c) for c in chosen.columns]
    )
