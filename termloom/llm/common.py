"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.staging import write_stage

# A word, as the quality, mixing, packing and de-duplication operators count it.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
# Entries of a per-process cache of words (about 220 bytes each); a full cache is emptied.
CACHE_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def indexed_words(texts: pa.Array, bytes_at_once: int = 4 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(distinct words, place of every word among them, word offsets of the texts) of runs of texts.

    Arrow splits and numbers the words, so Python sees each distinct word of a run once. White space
    at an end of a text gives an empty word. A run holds about ``bytes_at_once``, one text at least.
    """
    start = 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + bytes_at_once)))
        run = pc.fill_null(texts[start:stop], "")
        lists = pc.ascii_split_whitespace(run.cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        yield coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends.astype(np.int64)
        start = stop
    pa.default_memory_pool().release_unused()


def word_codes(texts: pa.Array) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text; each distinct word of a run is hashed once."""
    for words, places, ends in indexed_words(texts):
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
        full = pc.binary_length(words).to_numpy(zero_copy_only=False)[places] > 0
        kept = codes[places[full]]
        upto = np.concatenate([[0], np.cumsum(full)])
        for start, end in zip(upto[ends[:-1]], upto[ends[1:]]):
            yield kept[start:end]


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` words: one multiplier for each place, then a mix."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    rng = np.random.default_rng(n)
    factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for place in range(n):
            total += codes[place : len(codes) - n + 1 + place] * factors[place]
        return mixed(total)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


class Encoder:
    """Token ids of whole texts.

    The tokenizer drops ASCII white space and never joins what it separates, so a text's ids are
    those of its words one after another. Nor does it join full stops and commas to a letter or
    digit before them, or tell ASCII capitals apart, so a word is looked up as its core in small
    letters and its tail of such marks. A core is encoded once while it is in the cache.
    """

    def __init__(self, path: str, end_id: int, dtype: str, cache_words: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._end = np.array([end_id], dtype=dtype).tobytes()
        self._dtype = dtype
        self._cache_words = cache_words
        self._known: dict[str, bytes] = {}

    def _coded(self, parts: list[str]) -> list[bytes]:
        if len(self._known) > self._cache_words:
            self._known.clear()
        code = "I" if self._dtype == "<u4" else "H"
        new = list(set(parts).difference(self._known))
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            for part, got in zip(some, self._tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self._known[part] = array(code, got.ids).tobytes()
        return list(map(self._known.__getitem__, parts))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column and the end id, as little-endian integers."""
        width = np.dtype(self._dtype).itemsize
        for words, places, ends in indexed_words(texts):
            small = pc.utf8_rtrim(pc.ascii_lower(words), ".,")
            # Special tokens keep their case; a capital beyond ASCII may end in a mark when made small.
            plain = pc.and_(
                pc.match_substring_regex(small, r"[\p{Ll}\p{Lo}\p{Nd}]$"), pc.invert(pc.match_substring(words, "<|"))
            )
            tails = pc.if_else(plain, pc.replace_substring_regex(words, r"(?s)^.*?([.,]*)$", r"\1"), "")
            cores, tails = pc.if_else(plain, small, words).dictionary_encode(), tails.dictionary_encode()
            parts = cores.dictionary.to_pylist() + tails.dictionary.to_pylist()
            coded = self._coded(parts)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // width
            flat = np.frombuffer(b"".join(coded), dtype=self._dtype)
            units = np.empty((len(places), 2), np.int32)
            units[:, 0] = cores.indices.to_numpy(zero_copy_only=False)[places]
            units[:, 1] = tails.indices.to_numpy(zero_copy_only=False)[places] + len(cores.dictionary)
            units = units.ravel()
            taken = sizes[units]
            upto = np.concatenate([[0], np.cumsum(taken)])
            first = (np.cumsum(sizes) - sizes)[units]
            ids = flat[np.repeat(first - upto[:-1], taken) + np.arange(upto[-1])].tobytes()
            for start, end in zip(upto[2 * ends[:-1]], upto[2 * ends[1:]]):
                yield ids[width * start : width * end] + self._end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, dtype: str = "<u4", cache_words: int = CACHE_WORDS) -> Encoder:
    return Encoder(path, end_id, dtype, cache_words)


# A table of one row per group is broadcast up to this many rows; a larger one is joined by salted keys.
BROADCAST_ROWS = 100_000
SALTS = 32


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of many rows to a table with at most one row per key; null keys match each other.

    ``groups`` is written to the shared folder and counted first. Under the limit it is broadcast.
    Above it every group is repeated for each salt and the rows are dealt over the salts, so that
    no task gets all rows of a key. Both ways give the same rows. Only the count decides: Spark goes by the
    bytes of the packed file without the repeats, and so would send millions of rows through the driver.
    """
    groups = write_stage(groups, "groups")
    names = fresh(rows, *(f"group_{k}" for k in keys))
    right = groups.withColumnsRenamed(dict(zip(keys, names)))
    same = [rows[k].eqNullSafe(right[n]) for k, n in zip(keys, names)]
    if groups.count() <= limit:
        joined = rows.join(F.broadcast(right), same, "left")
        return joined.drop(*names)
    salt, salts = fresh(rows.join(groups.drop(*keys)), "salt", "salts")
    right = right.withColumn(salts, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    same = [rows[k].eqNullSafe(right[n]) for k, n in zip(keys, names)]
    return rows.join(right.hint("merge"), [rows[salt] == right[salts], *same], "left").drop(*names, salt, salts)
