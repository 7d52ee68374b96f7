"""TF-IDF inverted index over term texts, for word and character grams and exact names.

The index is three tables. ``terms`` has a row per term. ``vocab`` has a row per (analyzer,
token) with a number and its inverse document frequency. ``postings`` holds the weights; the list of a
token is cut into blocks of bounded size, so a token that occurs in every term never forms
one row or one group.

Exact names are a third analyzer beside words and characters: a normalised name is a token
of weight one. The exact-name bonus is then one more posting and needs no join of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.text import (
    normalize_name,
    pad_words,
    padded_char_ngrams,
    word_tokens,
    word_unigrams_and_bigrams,
)
from termloom.plans.staging import BROADCAST_BYTES, salted_join, spread, staging_folder, write_stage

WORD, CHAR, NAME = "w", "c", "n"
# Small enough that an Arrow batch of posting lists stays in the low hundreds of megabytes.
BLOCK_POSTINGS = 512
# In-memory bytes of a row beside its texts, and of one posting.
_ROW_BYTES = 96
_POSTING_BYTES = 16


@dataclass(frozen=True)
class TermIndex:
    """Tables of the index and their measured sizes, which decide about broadcasts."""

    terms: DataFrame
    vocab: DataFrame
    postings: DataFrame
    n_terms: int
    n_postings: int
    terms_bytes: int
    vocab_bytes: int
    postings_bytes: int


def build_text(label: Column, synonyms: Column, definition: Column) -> Column:
    """Indexed text: label and synonyms twice, then the definition."""
    joined = F.array_join(F.coalesce(synonyms, F.array().cast("array<string>")), " ; ")
    return F.concat_ws(" ", label, label, joined, joined, F.coalesce(definition, F.lit("")))


def term_names(terms: DataFrame) -> DataFrame:
    """Distinct (name, term_no) over normalised labels and synonyms."""
    names = F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))
    normal = F.array_distinct(F.transform(names, normalize_name))
    return terms.select(F.explode(normal).alias("name"), "term_no")


def _tagged(analyzer: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(analyzer).alias("analyzer"), t.alias("token")))


def _term_tokens(terms: DataFrame) -> DataFrame:
    """(term_no, tokens): all tokens of a term as one array, with repeats."""
    text = build_text(F.col("label"), F.col("synonyms"), F.col("definition"))
    names = F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))
    normal = F.array_distinct(F.transform(names, normalize_name))
    # Tokens are named in a step of their own, so that each text is scanned once per analyzer.
    staged = terms.select("term_no", text.alias("text"), normal.alias("names")).select(
        "term_no", "names", word_tokens(F.col("text")).alias("words"), pad_words(F.col("text")).alias("padded")
    )
    return staged.select(
        "term_no",
        F.concat(
            _tagged(WORD, word_unigrams_and_bigrams(F.col("words"))),
            _tagged(CHAR, padded_char_ngrams(F.col("padded"))),
            _tagged(NAME, F.col("names")),
        ).alias("tokens"),
    )


def smooth_idf(df: Column, n_terms: int) -> Column:
    return F.log((F.lit(1.0) + n_terms) / (F.lit(1.0) + df)) + 1.0


def term_frequency_weight(count: Column) -> Column:
    """Sublinear term frequency."""
    return F.log(count.cast("double")) + 1.0


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(term_no, analyzer, token, tf).

    Only the texts are shuffled, by ``term_no``; the far larger gram rows are then counted in
    the partition that made them.
    """
    texts = spread(terms.select("term_no", "label", "synonyms", "definition"), "term_no")
    return (
        _term_tokens(texts)
        # A plain explode would make all tokens once more, to test their number.
        .select("term_no", F.explode_outer("tokens").alias("t"))
        .filter(F.col("t").isNotNull())
        .groupBy("term_no", F.col("t.analyzer").alias("analyzer"), F.col("t.token").alias("token"))
        .agg(F.count("*").alias("tf"))
    )


def char_gram_counts(texts: DataFrame) -> DataFrame:
    """(token, n): character grams of all ``text`` and how often they occur.

    No gram spans two words, so equal words are counted first and only distinct words make grams.
    """
    words = texts.select(F.explode(F.split(pad_words(F.col("text")), " ")).alias("word")).filter(F.col("word") != "")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    # A word is small but makes many grams; the outer form keeps Spark from making them once more to test their number.
    padded = spread(counted, "word").select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"), "n")
    grams = padded.select(F.explode_outer(padded_char_ngrams(F.col("padded"))).alias("token"), "n")
    return grams.groupBy("token").agg(F.sum("n").alias("n"))


def build_vocab(counted: DataFrame, n_terms: int) -> DataFrame:
    """(analyzer, token, df, idf) of counted (term_no, analyzer, token): a term has one row of each token."""
    found = counted.groupBy("analyzer", "token").agg(F.count("*").alias("df"))
    idf = F.when(F.col("analyzer") == NAME, F.lit(1.0)).otherwise(smooth_idf(F.col("df"), n_terms))
    return found.withColumn("idf", idf)


def l2_normalise(weighted: DataFrame, *group: str, weight: str = "raw", name: str = "w") -> DataFrame:
    """Divide by the root of the squared sum over ``group``."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(*group)))
    return weighted.withColumn(name, F.col(weight) / norm)


def build_postings(counted: DataFrame, vocab: DataFrame, broadcast_vocab: bool = True) -> DataFrame:
    """(analyzer, token, token_no, term_no, df, w): normalised weights, flat.

    A vocabulary that may not be broadcast is joined by token and salt, as a gram may be in every term.
    """
    keys = ["analyzer", "token"]
    weighted = (
        (counted.join(F.broadcast(vocab), keys) if broadcast_vocab else salted_join(counted, vocab, keys, F.col("term_no"), "inner"))
        .withColumn("raw", term_frequency_weight(F.col("tf")) * F.col("idf"))
    )
    flat = l2_normalise(weighted, "term_no", "analyzer")
    return flat.select(
        "analyzer",
        "token",
        "token_no",
        "term_no",
        "df",
        F.when(F.col("analyzer") == NAME, F.lit(1.0)).otherwise(F.col("w")).alias("w"),
    )


def block_count(df: Column, block_postings: int = BLOCK_POSTINGS) -> Column:
    """Number of blocks of a token; follows from its document frequency alone."""
    return F.ceil(df / F.lit(block_postings)).cast("long")


_BLOCK_TYPE = (
    "analyzer string, token string, token_no long, block long, list array<struct<term_no:long,w:double>>, "
    "top double, terms binary, weights binary"
)


def _pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order each list by falling weight, state the largest, and pack the numbers."""
    for batch in batches:
        lists = batch.column(4)
        rows, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        terms, weights = (rows.field(name).to_numpy() for name in ("term_no", "w"))
        order = np.lexsort((terms, -weights, np.repeat(np.arange(len(lists)), np.diff(starts))))
        rows = rows.take(pa.array(order))
        # Offsets in bytes: every term number and every weight takes eight.
        offsets = pa.array(starts * 8, pa.int32())
        packed = [
            pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets.buffers()[1], pa.py_buffer(numbers[order].tobytes())])
            for numbers in (terms, weights)
        ]
        ordered = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows)
        tops = pa.array(weights[order][starts[:-1]])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], ordered, tops, *packed], [*batch.schema.names, "top", "terms", "weights"]
        )


def block_postings(postings: DataFrame, size: int = BLOCK_POSTINGS) -> DataFrame:
    """Cut each token's list into blocks of about ``size`` terms.

    A block is kept as rows in ``list`` and as packed numbers in ``terms`` and ``weights``, both by
    falling weight, with its largest weight in ``top``. No list is empty.
    """
    block = F.pmod(F.col("term_no"), block_count(F.col("df"), size))
    blocks = (
        postings.withColumn("block", block)
        .groupBy("analyzer", "token", "token_no", "block")
        .agg(F.collect_list(F.struct("term_no", "w")).alias("list"))
    )
    return blocks.mapInArrow(_pack_lists, _BLOCK_TYPE)


def postings_shards(index: TermIndex, shard_bytes: int) -> list[DataFrame]:
    """(token_no, terms, weights) in shards of at most ``shard_bytes``, as measured.

    Shard s of n holds the terms whose number leaves s when divided by n, counted from 0.
    """
    columns = ("token_no", "terms", "weights")
    shards = max(1, -(-index.postings_bytes // max(1, shard_bytes)))
    if shards == 1:
        return [index.postings.select(*columns)]
    while True:
        shards = min(shards, index.n_terms)
        row = F.posexplode(F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.transform(
                F.filter("list", lambda x: x["term_no"] % shards == s),
                lambda x: F.struct(F.floor(x["term_no"] / shards).cast("long").alias("term_no"), x["w"].alias("w")),
            ),
        )).alias("shard", "list")
        parts = index.postings.select("analyzer", "token", "token_no", row).filter(F.size("list") > 0)
        parts = parts.select("analyzer", "token", "token_no", F.col("shard").cast("long").alias("block"), "list")
        packed = parts.mapInArrow(_pack_lists, _BLOCK_TYPE)
        stored = write_stage(packed.select("block", "token", *columns), "shards")
        size = F.sum(F.octet_length("token") + _ROW_BYTES + F.octet_length("terms") / 8 * _POSTING_BYTES)
        largest = stored.groupBy("block").agg(size.alias("bytes")).agg(F.max("bytes")).first()[0]
        if largest <= shard_bytes or shards == index.n_terms:
            return [stored.filter(F.col("block") == s).select(*columns) for s in range(shards)]
        shards *= 2


def postings_rows(index: TermIndex) -> DataFrame:
    """Flat (analyzer, token, term_no, w) of the word and character analyzers."""
    return index.postings.filter(F.col("analyzer") != NAME).select("analyzer", "token", F.inline("list"))


def build_index(terms: DataFrame, path: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> TermIndex:
    """Build the index of numbered terms and write it below ``path`` (or the staging folder).

    Grams are made once: the counts of (term, token) are written, document frequencies are counted
    from them, and the second pass weighs them. Counts of a term are in one file, so with a small
    vocabulary only the counts by term and the finished postings are shuffled again.
    """
    spark = terms.sparkSession
    if path is None:
        path = f"{staging_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    columns = ["term_no", "id", "iri", "label", "synonyms", "definition", "parents"]
    stored_terms = write_stage(spread(terms.select(*columns), "term_no"), "terms", f"{path}/terms")
    n_terms = stored_terms.count()
    if n_terms == 0:
        raise ValueError("No labelled terms found")
    counted = write_stage(term_frequencies(stored_terms), "token-counts")
    numbered = build_vocab(counted, n_terms).withColumn("token_no", F.monotonically_increasing_id())
    vocab = write_stage(numbered, "vocab", f"{path}/vocab")
    blocks = block_postings(build_postings(counted, vocab, _vocab_bytes(vocab) <= broadcast_bytes))
    write_stage(blocks, "postings", f"{path}/postings")
    return load_index(spark, path)


def _vocab_bytes(vocab: DataFrame) -> int:
    return vocab.agg(F.coalesce(F.sum(F.octet_length("token") + _ROW_BYTES), F.lit(0))).first()[0]


def load_index(spark: SparkSession, path: str) -> TermIndex:
    """Read a saved index and measure its tables."""
    terms, vocab, postings = (spark.read.parquet(f"{path}/{t}") for t in ("terms", "vocab", "postings"))
    listed = F.octet_length("terms") / 8
    blocks = postings.agg(
        F.sum(listed).cast("long").alias("rows"),
        F.sum(F.octet_length("token") + _ROW_BYTES + listed * _POSTING_BYTES).cast("long").alias("bytes"),
    ).first()
    texts = F.octet_length(F.concat_ws("", "id", "iri", "label", "definition", "synonyms", "parents"))
    numbered = terms.agg(F.count("*").alias("rows"), F.sum(texts + 2 * _ROW_BYTES).alias("bytes")).first()
    return TermIndex(
        terms=terms,
        vocab=vocab,
        postings=postings,
        n_terms=numbered["rows"],
        n_postings=blocks["rows"] or 0,
        terms_bytes=numbered["bytes"] or 0,
        vocab_bytes=_vocab_bytes(vocab),
        postings_bytes=blocks["bytes"] or 0,
    )


def save_index(index: TermIndex, path: str) -> None:
    """Copy an index to ``path``; refuses to overwrite."""
    write_stage(index.terms, "terms", f"{path}/terms")
    write_stage(index.vocab, "vocab", f"{path}/vocab")
    write_stage(index.postings, "postings", f"{path}/postings")
