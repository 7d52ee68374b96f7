"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termloom.llm.common import CACHE_WORDS, encoder

CAPACITY = 2048
# A piece is not cut if a bin full of such pieces leaves at most this part of its room empty.
SLACK = 1 / 64


@lru_cache(maxsize=8)
def cuts(length: int, capacity: int, slack: float) -> tuple[int, ...]:
    """Lengths of the pieces into which a remainder of under ``capacity`` tokens is cut.

    A piece of class k, that is of a length in (capacity / (k + 1), capacity / k], shares its bin
    with k - 1 others. If k of them leave too much room, a piece as long as class k + 1 allows is
    cut off first and the rest, which is far smaller, is looked at again.
    """
    pieces = []
    while length:
        k = capacity // length
        if capacity - k * length <= slack * capacity:
            pieces.append(length)
            break
        pieces.append(capacity // (k + 1))
        length -= pieces[-1]
    return tuple(pieces)


class Packer:
    """The bins of one worker. It holds at most one open bin of each class.

    ``held`` makes what a bin keeps for a piece out of its document, start and length, so that a
    bin need not keep whole documents.
    """

    def __init__(self, capacity: int, slack: float, held: Callable = lambda document, start, length: document) -> None:
        self.capacity = capacity
        self._held = held
        self._cuts = [cuts.__wrapped__(n, capacity, slack) for n in range(capacity)]
        self._open: dict[int, list] = defaultdict(list)
        self._bins = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self._bins, offset)
            offset += piece[2]
        self._bins += 1

    def add(self, document: object, tokens: int) -> Iterator[tuple]:
        """(document, start, length, bin, offset) of each piece whose bin is full now."""
        start = 0
        for length in [self.capacity] * (tokens // self.capacity) + list(self._cuts[tokens % self.capacity]):
            k = self.capacity // length
            bin_ = self._open[k]
            bin_.append((self._held(document, start, length), start, length))
            start += length
            if len(bin_) == k:
                del self._open[k]
                yield from self._close(bin_)

    def finish(self) -> Iterator[tuple]:
        """Pieces of the bins still open, at most k - 1 of each class, together by first fit."""
        left = sorted((p for bin_ in self._open.values() for p in bin_), key=lambda p: -p[2])
        rooms: list[int] = []
        held: list[list] = []
        for piece in left:
            at = next((i for i, room in enumerate(rooms) if room >= piece[2]), len(rooms))
            if at == len(rooms):
                rooms.append(self.capacity)
                held.append([])
            rooms[at] -= piece[2]
            held[at].append(piece)
        for pieces in held:
            yield from self._close(pieces)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    slack: float = SLACK,
    keep_ids: bool = True,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens.

    Method: lengths fall into reciprocal-capacity classes, and a bin of class k takes exactly k
    pieces. Every task fills the bins of its own rows; nothing is shuffled, and a task that is run
    again gives the same rows. When a task ends, the pieces of its unfinished bins (a number that
    depends on ``capacity`` alone) are put together by first fit.

    Result: one row per piece with the document's id, ``start`` (its ids before the piece),
    ``length``, ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence, gapless from 0) and, with ``keep_ids``, ``ids`` as little-endian 32-bit integers.

    ``cache_words`` words at most (about 220 bytes each) keep their ids in a task's cache; it changes speed and
    memory alone.

    Null or empty texts hold the end id alone. Null ids stay null; repeated rows are packed each on
    its own. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    id_type = docs.schema[id_column].dataType
    fields = [
        T.StructField(id_column, id_type),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id, "<u4", cache_words)
        # The open bins hold less than one sequence of ids for each class, however long the documents.
        packer = Packer(capacity, slack, lambda d, start, length: (d[0], d[1][4 * start : 4 * (start + length)], len(d[1]) // 4))
        first = TaskContext.get().partitionId() << 33

        def rows(pieces: Iterator[tuple]) -> Iterator[tuple]:
            for (doc, part, tokens), start, length, bin_, offset in pieces:
                yield (doc, start, length, zlib.crc32(part), tokens, first + bin_, offset, part)[: len(fields)]

        def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.column(batch.column(1))):
                yield from packer.add((doc, ids), len(ids) // 4)

        schema = None
        for batch in batches:
            if schema is None:
                schema = _schema(batch.schema.field(0).type, id_column, keep_ids)
            yield from _in_batches(rows(pieces_of(batch)), schema)
        if schema is not None:
            yield from _in_batches(rows(packer.finish()), schema)

    return docs.select(id_column, text_column).mapInArrow(run, T.StructType(fields))


def _schema(id_type: pa.DataType, id_column: str, keep_ids: bool) -> pa.Schema:
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [(id_column, id_type), *((n, pa.int64()) for n in longs)]
    return pa.schema(fields + [("ids", pa.binary())] * keep_ids)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()
