"""Similarity join on word n-grams by MinHash banding."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import fresh, gram_codes, mixed, word_codes
from termloom.plans.staging import write_stage

WORDS = 5
THRESHOLD = 0.8
# Chance that a pair at the threshold is compared. The bands follow from it.
RECALL = 0.9999
HASHES = 128
# Members of one comparison block; a larger bucket is cut into a grid of blocks.
BLOCK = 512


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which ``hashes`` values still reach ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        miss = 1.0 - threshold**rows
        bands = int(np.ceil(np.log(1.0 - recall) / np.log(miss))) if miss > 0 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("Too few hashes for this recall")
    return best


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a shorter one is one gram of all its words."""
    for codes in word_codes(texts):
        yield np.unique(gram_codes(codes, min(n, len(codes)))) if len(codes) else codes


class BandHasher:
    """Band hashes of a gram set.

    Grams are well mixed already, so a random odd multiplier orders them anew for each MinHash value.
    """

    def __init__(self, bands: int, rows: int, seed: int = 41) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self._factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._places = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for start in range(0, len(grams), 2048):  # bounded memory for very long texts
                np.minimum(low, (grams[start : start + 2048] * self._factors[:, None]).min(axis=1), out=low)
            return mixed((low.reshape(self.bands, self.rows) * self._places).sum(axis=1)).view(np.int64)


def linked_pairs(sizes: np.ndarray, owner: np.ndarray, grams: np.ndarray, wanted: np.ndarray, least: Fraction) -> np.ndarray:
    """Of the pairs ``wanted`` (a square mask) those whose gram sets have a Jaccard similarity of ``least``."""
    n = len(sizes)
    both = np.zeros((n, n), dtype=np.int64)
    _, gram, seen = np.unique(grams, return_inverse=True, return_counts=True)
    shared = seen[gram] > 1
    gram, owner = gram[shared], owner[shared]
    if len(gram):
        kinds, gram = np.unique(gram, return_inverse=True)
        pairs = float((seen[seen > 1].astype(float) ** 2).sum())
        if n <= 32 or 60 * pairs < n * n * len(kinds):  # the cheaper of two exact ways to count
            order = np.argsort(gram, kind="stable")
            by_gram, counts = owner[order], np.bincount(gram)
            starts = np.cumsum(counts) - counts
            for i in range(n):
                mine = gram[np.searchsorted(owner, i) : np.searchsorted(owner, i + 1)]
                if len(mine) and wanted[i].any():
                    lengths = counts[mine]
                    at = np.arange(lengths.sum()) + np.repeat(starts[mine] - (np.cumsum(lengths) - lengths), lengths)
                    both[i] = np.bincount(by_gram[at], minlength=n)
        else:
            width = 4096
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
            for lo in range(0, len(kinds), width):
                a, b = np.searchsorted(gram, [lo, lo + width])
                cells = np.zeros((n, width), dtype=np.float32)
                cells[owner[a:b], gram[a:b] - lo] = 1
                both += (cells @ cells.T).astype(np.int64)
    total = sizes[:, None] + sizes[None, :] - both
    return wanted & (both * least.denominator >= total * least.numerator) & (total > 0)


def _compare(band: int, keys: np.ndarray, side: np.ndarray, copies: np.ndarray, bands: np.ndarray,
             packed: list[bytes], same_side: bool, least: Fraction) -> pd.DataFrame:
    """Link counts and a spanning forest of one block: (key, links, root) of each member with a link."""
    n = len(keys)
    wanted = np.triu(np.ones((n, n), bool), 1) if same_side else side[:, None] < side[None, :]
    for earlier in range(band):  # each pair is looked at in the first band that it shares
        wanted &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
    sizes = np.array([len(p) // 8 for p in packed], dtype=np.int64)
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    wanted &= small * least.denominator >= large * least.numerator
    if not wanted.any():
        return pd.DataFrame({"key": keys[:0], "links": copies[:0], "root": keys[:0]})
    grams = np.frombuffer(b"".join(packed), dtype="<u8")
    linked = linked_pairs(sizes, np.repeat(np.arange(n), sizes), grams, wanted, least)
    linked |= linked.T
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    has = linked.any(axis=1)
    return pd.DataFrame({"key": keys[has], "links": (linked @ copies)[has], "root": keys[label[has]]})


def text_key(text_column: str):
    return F.md5(F.coalesce(F.col(text_column), F.lit("")))


def join_similar(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
) -> DataFrame:
    """(id, text_key, class_id, n_links, n_words>0 as has_words, class_root) of every document.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at least
    ``threshold``; ``n_links`` counts the other documents linked to one, and ``class_id`` is the
    smallest id that can be reached by links. ``class_root`` is a text key that only the texts of one
    class share, whatever their ids; null without words. A text of fewer than ``words`` words is one gram.

    Method: equal texts are joined first. MinHash values are cut into bands, chosen so that a pair at
    the threshold meets with probability ``recall``; thin rows are shuffled on band hashes. A bucket
    that agrees in an earlier band as a whole is left out, and a pair is compared only in the first
    band that it shares, on the full gram sets of 64-bit hashes. Buckets of over ``BLOCK`` texts are cut into
    a grid of blocks. A block returns counts and a spanning forest, never its pairs, so the rows that
    are shuffled grow with the documents. Classes are closed over blocks by label propagation.

    Null and blank texts have no grams: no links, and a class of their own. A null id is never the
    smallest, and a class of null ids alone has a null class. Repeated rows are documents of their
    own and linked to each other. An empty table gives no rows; other columns are not read.
    """
    n_bands, n_rows = choose_bands(threshold, recall, hashes)
    least = Fraction(threshold).limit_denominator(10_000)
    id_type = docs.schema[id_column].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = BandHasher(n_bands, n_rows)
        for batch in batches:
            flat, ends = [], [0]
            for grams in gram_sets(batch.column(1), words):
                if len(grams):
                    flat.append(hasher(grams))
                ends.append(ends[-1] + (n_bands if len(grams) else 0))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["doc", "key", "bands"])

    keyed = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"), text_key(text_column).alias("key"))
    signed = write_stage(keyed.mapInArrow(sign, f"doc {id_type}, key string, bands array<bigint>"), "signatures")
    worded = signed.filter(F.size("bands") > 0)
    texts = worded.groupBy("key").agg(
        F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    texts = write_stage(texts, "texts")
    thin = texts.select("key", F.posexplode("bands").alias("band", "code"))
    met = thin.groupBy("band", "code").agg(F.count("*").alias("n")).filter("n > 1")
    members = thin.join(met, ["band", "code"]).join(texts.select("key", "bands", "copies"), "key")
    members = write_stage(members, "members")
    agree = [F.coalesce(F.min(F.get("bands", F.lit(i))) == F.max(F.get("bands", F.lit(i))), F.lit(False)) & (F.col("band") > i)
             for i in range(n_bands)]
    useful = members.groupBy("band", "code").agg(*[a.alias(f"a{i}") for i, a in enumerate(agree)])
    useful = useful.filter(~F.greatest(*[F.col(f"a{i}") for i in range(n_bands)])).select("band", "code")
    members = members.join(useful, ["band", "code"])
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumns({"chunks": chunks, "side": F.pmod(F.xxhash64("key"), chunks).cast("int")})
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "band", "code", "key", "copies", "bands", "side",
        F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
    )
    grams = _gram_sets(docs, texts, members, id_column, text_column, words)
    blocks = blocks.join(grams, "key")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        one = block["lo"].iloc[0] == block["hi"].iloc[0]
        bands = np.stack(block["bands"].to_numpy())
        found = _compare(int(block["band"].iloc[0]), block["key"].to_numpy(dtype=object), block["side"].to_numpy(),
                         block["copies"].to_numpy(), bands, list(block["grams"]), one, least)
        return found.astype({"links": "int64"})

    links = blocks.groupBy("band", "code", "lo", "hi").applyInPandas(compare, "key string, links bigint, root string")
    links = write_stage(links, "links")
    roots = close_classes(links.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    rooted = texts.select("key", "doc", "copies").join(counted, "key", "left").join(roots, "key", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "key"))
    lowest = rooted.groupBy("root").agg(F.min("doc").alias("class_id"))
    per_text = rooted.join(lowest, "root").select(
        "key", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    has = F.size("bands") > 0
    return signed.join(per_text, "key", "left").select(
        F.col("doc").alias(id_column),
        F.col("key").alias("text_key"),
        F.when(has, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"),
        F.when(has, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        has.alias("has_words"),
        F.when(has, F.col("root")).alias("class_root"),
    )


def _gram_sets(docs: DataFrame, texts: DataFrame, members: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """(key, grams) of the texts in ``members``, from one document of each."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [g.astype("<u8").tobytes() for g in gram_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "grams"])

    wanted = texts.join(members.select("key").distinct(), "key", "left_semi").select("key", "doc")
    rows = docs.select(text_key(text_column).alias("key"), F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    same = [rows["key"] == wanted["key"], rows["doc"].eqNullSafe(wanted["doc"])]
    found = rows.join(wanted, same, "left_semi").select("key", "text")
    return found.mapInArrow(grams, "key string, grams binary").dropDuplicates(["key"])


def close_classes(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key reachable from each key over the edges (a, b).

    Every round takes the smallest label among neighbours and then the label of that label; each
    round is written to the shared folder. Stars, which blocks send, close in a few rounds.
    """
    both = write_stage(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = write_stage(both.groupBy(F.col("a").alias("key")).agg(F.least("a", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        low = labels.join(near, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("key").alias("mid"), F.col("root").alias("far"))
        new = low.join(jump, "mid").select("key", "old", F.least("mid", "far").alias("root"))
        new = write_stage(new, "labels")
        labels = new.select("key", "root")
        if new.filter("old <> root").isEmpty():
            return labels


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id. Texts without words stay.

    Classes are told apart by their root, as texts without links may share an id or have none. A null id
    is chosen only if the class has no other; of several texts with the id that of the smallest key is
    kept. Rows are matched by id and text; of rows that are equal in both one is kept.
    """
    joined = join_similar(docs, id_column, text_column).filter("has_words")
    first = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("text_key").alias("text")))
    keep = joined.groupBy("class_root").agg(first.alias("first"))
    (key,) = fresh(docs, "keep_key")
    both = lambda doc, text: F.concat(text, F.coalesce(doc.cast("string"), F.lit("-")))
    keep = write_stage(keep.select(both(F.col("first.id"), F.col("first.text")).alias(key)), "keep")
    # One column holds id and text key, so that the join and the removal of equal rows share one shuffle.
    rows = docs.withColumn(key, both(F.col(id_column), text_key(text_column)))
    kept = rows.join(keep, key, "left_semi").dropDuplicates([key]).select(docs.columns)
    blank = docs.filter(F.coalesce(F.regexp_replace(text_column, r"[\x20\x09-\x0D]+", ""), F.lit("")) == "")
    return kept.unionByName(blank)
