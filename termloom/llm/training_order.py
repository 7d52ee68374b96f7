"""Token sequences in training order, as fixed-stride binary shards."""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import encoder, mixed
from termloom.plans.staging import staging_folder, write_stage

SEQUENCE = 2048
SHARD_SEQUENCES = 2048
ROUNDS = 6
# Nothing else runs beside this operator, so more words may be kept than in packing.
CACHE_WORDS = 600_000


def feistel(values: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, value by value and without a table.

    A balanced Feistel network permutes the next power of four. What falls beyond ``size`` is sent
    through again (cycle-walking), which stops after under four passes on average.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % 2**64))
    out = np.asarray(values, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


class Chunker:
    """Cuts the token stream of a task into sequences and notes whose tokens each holds."""

    def __init__(self, length: int, width: int) -> None:
        self._room = length * width
        self._held = bytearray()
        self._docs: list = []

    def add(self, doc: object, ids: bytes) -> Iterator[tuple[bytes, list]]:
        view, at = memoryview(ids), 0
        while at < len(ids):
            part = view[at : at + self._room - len(self._held)]
            self._held += part
            self._docs.append(doc)
            at += len(part)
            if len(self._held) == self._room:
                yield bytes(self._held), self._docs
                self._held, self._docs = bytearray(), []

    def finish(self) -> Iterator[tuple[bytes, list]]:
        if self._held:
            yield bytes(self._held), self._docs


def materialise(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: int = 20_240_229,
    length: int = SEQUENCE,
    shard_sequences: int = SHARD_SEQUENCES,
    end_id: int = 1,
    pad_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    dtype: str = "<u2",
) -> DataFrame:
    """Write all token sequences below ``path`` in training order and return the manifest.

    The documents of a task form one stream of ids, each text closed by ``end_id``, cut into sequences
    of ``length``; the last of a task is padded. The sequences are written once to the shared folder,
    compressed, and counted by task, so that every one has a number in 0 .. N - 1 (one count per task
    reaches the driver). The keyed Feistel permutation turns the number into a global slot. Slots are
    range-partitioned by shard, and each shard is one file ``shard-NNNNNNNN.bin`` of fixed-stride
    records in slot order: slot s is record ``s % shard_sequences`` of shard ``s // shard_sequences``, so a
    reader can start anywhere. A file is written under another name and then renamed; a task that is
    run again writes the same bytes. ``path`` may be any URI that pyarrow can write.

    Manifest: sequence, slot, shard, byte_offset, n_tokens (without padding), ids_crc32 (of the whole
    record) and doc_ids in order. Null and empty texts are their end id; null ids stay null in the
    list; repeated rows are documents of their own; an empty table writes no file.
    """
    width = np.dtype(dtype).itemsize
    id_type = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunker = encoder(tokenizer, end_id, dtype, CACHE_WORDS), Chunker(length, width)
        part, done, kind = TaskContext.get().partitionId(), 0, None

        def batch_of(found: list[tuple[bytes, list]]) -> pa.RecordBatch:
            nonlocal done
            numbers = np.arange(done, done + len(found), dtype=np.int64)
            done += len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), part, np.int32)), pa.array(numbers),
                 pa.array([len(f[0]) // width for f in found], pa.int32()),
                 pa.array([zstandard.compress(f[0], 3) for f in found], pa.binary()),
                 pa.array([f[1] for f in found], pa.list_(kind))],
                names=["part", "number", "n_tokens", "ids", "doc_ids"],
            )

        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for doc, coded in zip(batch.column(0).to_pylist(), encode.column(batch.column(1))):
                for piece in chunker.add(doc, coded):
                    found.append(piece)
                    if len(found) == 1024:
                        yield batch_of(found)
                        found = []
            if found:
                yield batch_of(found)
        if kind is not None and (last := list(chunker.finish())):
            yield batch_of(last)

    shape = f"part int, number bigint, n_tokens int, ids binary, doc_ids array<{id_type}>"
    cut_up = write_stage(docs.select(id_column, text_column).mapInArrow(cut, shape), "sequences")
    counts = dict(cut_up.groupBy("part").count().collect())
    total, first = 0, {}
    for part in sorted(counts):
        first[part] = total
        total += counts[part]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.array([first[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
            sequence = batch.column("number").to_numpy() + starts
            slot = feistel(sequence, total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sequence), pa.array(slot), pa.array((slot // shard_sequences).astype(np.int32)),
                 batch.column("n_tokens"), batch.column("ids"), batch.column("doc_ids")],
                names=["sequence", "slot", "shard", "n_tokens", "ids", "doc_ids"],
            )

    shape = f"sequence bigint, slot bigint, shard int, n_tokens int, ids binary, doc_ids array<{id_type}>"
    shards = -(-total // shard_sequences)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        cut_up.mapInArrow(place, shape)
        .repartitionByRange(max(1, min(shards, tasks)), "shard")
        .sortWithinPartitions("shard", "slot")
    )
    write = _shard_writer(path, shard_sequences, length, np.array([pad_id], dtype=dtype).tobytes())
    return ordered.mapInArrow(
        write, f"sequence bigint, slot bigint, shard int, byte_offset bigint, n_tokens int, ids_crc32 bigint, doc_ids array<{id_type}>"
    )


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return pafs.LocalFileSystem(), path


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _shard_writer(path: str, shard_sequences: int, length: int, pad: bytes):
    width, stride = len(pad), length * len(pad)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_folder(path)
        files.create_dir(folder, recursive=True)
        shard, out, temporary = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                files.move(temporary, posixpath.join(folder, shard_name(shard)))

        for batch in batches:
            shards, crcs = batch.column("shard").to_pylist(), []
            for own, ids in zip(shards, batch.column("ids")):
                if own != shard:
                    close()
                    shard, temporary = own, posixpath.join(folder, f".{uuid.uuid4().hex}")
                    out = files.open_output_stream(temporary)
                record = zstandard.decompress(ids.as_py())
                record += pad * (length - len(record) // width)
                out.write(record)
                crcs.append(zlib.crc32(record))
            slots = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence"), batch.column("slot"), batch.column("shard"),
                 pa.array(slots % shard_sequences * stride), batch.column("n_tokens"),
                 pa.array(crcs, pa.int64()), batch.column("doc_ids")],
                names=["sequence", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"],
            )
        close()

    return write


def read_slots(path: str, start: int, stop: int, length: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES,
               dtype: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences at slots ``start`` to ``stop`` - 1, read in order: how training resumes."""
    files, folder = open_folder(path)
    stride = length * np.dtype(dtype).itemsize
    while start < stop:
        shard, record = divmod(start, shard_sequences)
        with files.open_input_file(posixpath.join(folder, shard_name(shard))) as source:
            source.seek(record * stride)
            for _ in range(min(stop - start, shard_sequences - record)):
                yield np.frombuffer(source.read(stride), dtype=dtype)
                start += 1


def training_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Materialise all documents in a new folder below the shared one and return the manifest."""
    spark = docs.sparkSession
    folder = f"{staging_folder(spark).rstrip('/')}/training-{uuid.uuid4().hex}"
    return write_stage(materialise(docs, folder, tokenizer), "manifest", f"{folder}-manifest")
