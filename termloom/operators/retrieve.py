"""Batch retrieval: weighted cosine of four channels, exact-name bonus, top-k per query.

The score is linear in the query weights, so the value text and the context text are folded
into one weight per token before the postings are read: one equi-join replaces four products.
Each distinct (query, field) is scored once, whatever the number of rows that ask for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import fixed_values as V
from termloom.functions.text import (
    blank_to_null,
    neighbour_pairs,
    normalize_name,
    pad_words,
    padded_char_ngrams,
    strip_text,
    word_tokens,
    word_unigrams_and_bigrams,
)
from termloom.operators.blockmax import MARGIN, PostingShard
from termloom.operators.index import (
    CHAR,
    NAME,
    WORD,
    TermIndex,
    block_count,
    postings_shards,
)
from termloom.plans.staging import BROADCAST_BYTES, broadcast_if_small, salted_join, spread, write_stage

# Ranks compare scores at this many places, so equal texts tie whatever the order of summation.
RANK_PLACES = 9
SCORE_PLACES = 4
# A shard of the postings is held by every Python worker, with a second copy by term.
SHARD_BYTES = BROADCAST_BYTES // 4
# Above this many query rows per token, a shuffled join spreads the rows of the token.
SALT_ROWS = 100_000
# Rows of blank queries, which have no key, are dealt over so many parts.
BLANK_SALTS = 4096


def query_key(query: Column, field: Column) -> Column:
    """16-byte key of a (query, field) pair; the length prefix keeps pairs apart."""
    field = F.coalesce(field, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(field).cast("string"), F.lit(":"), field, query)))


def concept_queries(concepts: DataFrame) -> DataFrame:
    """Add ``query`` and ``field`` to concepts; a blank query is null and gets no hits."""
    def first_filled(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])

    return concepts.withColumn(
        "query", blank_to_null(first_filled("normalized_query", "raw_value"))
    ).withColumn("field", F.coalesce(first_filled("source_field", "concept_type"), F.lit("")))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Each (query, field) once, partitioned by its key; blank queries are left out."""
    query, field = strip_text(F.col("query")), F.coalesce("field", F.lit(""))
    once = (
        queries.select(query.alias("query"), field.alias("field"))
        .filter(F.col("query") != "")
        .groupBy(query_key(F.col("query"), F.col("field")).alias("qkey"))
        .agg(F.first("query").alias("query"), F.first("field").alias("field"))
    )
    # Repeats are gone, so a hot query is one row by now; each row is about to grow a lot.
    return spread(once, "qkey")


def _tagged(analyzer: str, in_value: int, tokens: Column) -> Column:
    return F.transform(
        tokens,
        lambda t: F.struct(F.lit(analyzer).alias("analyzer"), F.lit(in_value).alias("in_value"), t.alias("token")),
    )


def query_weights(asked: DataFrame, index: TermIndex, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(qkey, analyzer, token, token_no, df, qw): folded weight of every token that the index knows.

    With a vocabulary under the limit, grams and weights of a query stay in the partition that
    ``distinct_queries`` put it in. A larger one is joined by token and salt, as a gram may be in
    every query.

    The context text is the field name followed by the value, so each value token belongs to
    both texts. Only the tokens of the field, and the word pair where field and value meet, are
    added for the context. Unknown tokens leave before they are counted; the name token stays
    even when no term has that name, so every query keeps a row.
    """
    field_text = F.replace(F.col("field"), F.lit("_"), F.lit(" "))
    texts = asked.select(
        "qkey",
        normalize_name(F.col("query")).alias("name"),
        word_tokens(F.col("query")).alias("words"),
        word_tokens(field_text).alias("field_words"),
        pad_words(F.col("query")).alias("padded"),
        pad_words(field_text).alias("field_padded"),
    )
    joint = F.concat("field_words", F.slice("words", 1, 1))
    tokens = F.concat(
        _tagged(WORD, 1, word_unigrams_and_bigrams(F.col("words"))),
        _tagged(WORD, 0, F.concat("field_words", neighbour_pairs(joint))),
        _tagged(CHAR, 1, padded_char_ngrams(F.col("padded"))),
        _tagged(CHAR, 0, padded_char_ngrams(F.col("field_padded"))),
        _tagged(NAME, 1, F.array("name")),
    )
    # Spark tests the number of what a plain explode reads, and makes all tokens twice more for it.
    grams = texts.select("qkey", F.explode_outer(tokens).alias("t")).filter(F.col("t").isNotNull()).select("qkey", "t.*")
    if index.vocab_bytes <= broadcast_bytes:
        looked_up = grams.join(F.broadcast(index.vocab), ["analyzer", "token"], "left")
    else:
        looked_up = salted_join(grams, index.vocab, ["analyzer", "token"], F.col("qkey"), "left")
    known = looked_up.filter(F.col("idf").isNotNull() | (F.col("analyzer") == NAME))
    counted = known.groupBy("qkey", "analyzer", "token").agg(
        F.sum("in_value").alias("in_value"),
        F.count("*").alias("in_context"),
        F.max("df").alias("df"),
        F.max("idf").alias("idf"),
        F.max("token_no").alias("token_no"),
    )

    def raw(count: str) -> Column:
        return F.when(F.col(count) > 0, (F.log(F.col(count).cast("double")) + 1.0) * F.col("idf")).otherwise(0.0)

    group = Window.partitionBy("qkey", "analyzer")

    def unit(name: str) -> Column:
        norm = F.sqrt(F.sum(F.col(name) * F.col(name)).over(group))
        return F.when(norm > 0, F.col(name) / norm).otherwise(0.0)

    def coefficient(word: float, char: float, name: float) -> Column:
        return F.when(F.col("analyzer") == WORD, word).when(F.col("analyzer") == CHAR, char).otherwise(name)

    folded = coefficient(V.WORD_VALUE_WEIGHT, V.CHAR_VALUE_WEIGHT, V.EXACT_NAME_BONUS) * unit("raw_value") + (
        coefficient(V.WORD_CONTEXT_WEIGHT, V.CHAR_CONTEXT_WEIGHT, 0.0) * unit("raw_context")
    )
    return (
        counted.withColumn("raw_value", raw("in_value"))
        .withColumn("raw_context", raw("in_context"))
        .select("qkey", "analyzer", "token", "token_no", F.coalesce("df", F.lit(1)).alias("df"), folded.alias("qw"))
    )


def _salted_join(weights: DataFrame, postings: DataFrame, salt_rows: int) -> DataFrame:
    """Token join of all pairs for an index that is too large to broadcast.

    A frequent token is a grid: its postings are cut into blocks, and its query rows are dealt
    to salts. Each cell of the grid is a separate join key, so no task gets a whole token.
    """
    keys = ["analyzer", "token"]
    busy = (
        weights.groupBy(*keys)
        .agg(F.count("*").alias("asking"))
        .filter(F.col("asking") > salt_rows)
        .select(*keys, F.ceil(F.col("asking") / F.lit(salt_rows)).cast("int").alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1))
    blocks = F.sequence(F.lit(0).cast("long"), block_count(F.col("df")) - 1)
    asking = (
        weights.join(busy, keys, "left")
        .withColumn("salt", F.pmod(F.xxhash64("qkey"), salts).cast("int"))
        .select("qkey", *keys, "qw", "salt", F.explode(blocks).alias("block"))
    )
    listed = postings.join(busy, keys, "left").select(
        *keys, "block", "list", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    return asking.join(listed, [*keys, "block", "salt"], "left")


def score_terms(
    asked: DataFrame,
    index: TermIndex,
    broadcast_bytes: int = BROADCAST_BYTES,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """(qkey, term_no, score) for every term that shares a token or a name with the query.

    A query also keeps one row without a term, which sorts last and marks a query without hits.

    The result has a row for nearly every pair, so this is for analysis; ``retrieve`` makes no such rows.
    Under the limit, products are summed in arrays beside the shared postings, shard by shard, and no row is made of
    them; a larger index is joined.
    """
    weights = query_weights(asked, index, broadcast_bytes)
    if index.postings_bytes <= broadcast_bytes:
        return _summed_in_arrays(weights, index)
    joined = _salted_join(weights, index.postings, salt_rows)
    products = joined.select("qkey", "qw", F.inline_outer("list"))
    return products.groupBy("qkey", "term_no").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def _summed_in_arrays(weights: DataFrame, index: TermIndex) -> DataFrame:
    shards = postings_shards(index, SHARD_BYTES)
    per_query = _one_row_each(weights)
    if len(shards) > 1:
        per_query = write_stage(per_query, "query-weights")
    scores = None
    for shard, postings in enumerate(shards):
        shared = _shared_shard(per_query.sparkSession, postings, index, shard, len(shards))
        part = per_query.mapInArrow(_whole_scores(shared, shard, len(shards)), f"qkey binary, hits {RAW_HIT_TYPE}")
        part = part.select("qkey", F.inline("hits"))
        scores = part if scores is None else scores.unionByName(part)
    return scores


def _one_row_each(weights: DataFrame) -> DataFrame:
    """(qkey, tokens, weights) of each query."""
    # Tokens that no term has, such as an unknown name, only keep the row of their query.
    tokens = F.struct(F.coalesce("token_no", F.lit(-1)).alias("token_no"), "qw")
    return weights.groupBy("qkey").agg(F.collect_list(tokens).alias("t")).select(
        "qkey", F.col("t.token_no").alias("tokens"), F.col("t.qw").alias("weights")
    )


def best_hits(found: DataFrame, k: int) -> DataFrame:
    """(qkey, hits): the best ``k`` of raw (term_no, score) hits as (rank, score, term_no), rounded here alone."""
    keyed = F.transform("hits", lambda h: F.struct((-F.round(h["score"], RANK_PLACES)).alias("key"), h["term_no"].alias("term_no"), h["score"].alias("score")))
    ranked = F.transform(
        F.slice(F.array_sort(keyed), 1, k),
        lambda h, i: F.struct((i + 1).alias("rank"), F.round(h["score"], SCORE_PLACES).alias("score"), h["term_no"].alias("term_no")),
    )
    return found.select("qkey", ranked.alias("hits"))


RAW_HIT_TYPE = "array<struct<term_no:bigint,score:double>>"
HIT_TYPE = "array<struct<rank:int,score:double,term_no:bigint>>"


def half_up(numbers: np.ndarray, places: int) -> np.ndarray:
    """Rounded as Spark's ``round`` does: by the shortest decimal form, halves away from zero."""
    unit = Decimal(1).scaleb(-places)
    return np.array([float(Decimal(repr(float(x))).quantize(unit, ROUND_HALF_UP)) for x in numbers], dtype=float)


def _best_of(terms: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and sums of the best ``k`` positive sums, best first."""
    limit = np.partition(sums, len(sums) - k)[len(sums) - k] if k < len(sums) else 0.0
    # Rounding can lift a sum to the k-th best only from within one unit of the last place.
    kept = (sums >= limit - MARGIN) & (sums > 0)
    terms, sums = terms[kept], sums[kept]
    order = np.lexsort((terms, -half_up(sums, RANK_PLACES)))[:k]
    return terms[order], sums[order]


# Scores that leave a Python worker in one batch.
BATCH_SCORES = 500_000


def _whole_scores(
    postings: Broadcast, shard: int, shards: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All scores of each query in one shard; in the first, a hit of nulls for a query with a token that no term has."""

    def hits(keys: list[bytes], found: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
        terms = np.concatenate([np.append(t * shards + shard, [-1] * lacks) for t, _, lacks in found]).astype(np.int64)
        scores = np.concatenate([np.append(x, [0.0] * lacks) for _, x, lacks in found])
        none = terms < 0
        rows = pa.StructArray.from_arrays([pa.array(terms, mask=none), pa.array(scores, mask=none)], ["term_no", "score"])
        ends = np.cumsum([0, *(len(t) + lacks for t, _, lacks in found)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], ["qkey", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched: PostingShard = postings.value
        for batch in batches:
            tokens, weights = batch.column(1), batch.column(2)
            ends = tokens.offsets.to_numpy()
            numbers, parts = tokens.values.to_numpy(), weights.values.to_numpy()
            keys, found, held = [], [], 0
            for key, lo, hi, at in zip(batch.column(0), ends[:-1], ends[1:], weights.offsets.to_numpy()):
                lacks = shard == 0 and bool((numbers[lo:hi] < 0).any())
                keys.append(key.as_py())
                found.append((*searched.scores(numbers[lo:hi], parts[at : at + hi - lo]), lacks))
                held += len(found[-1][0])
                if held >= BATCH_SCORES:
                    yield hits(keys, found)
                    keys, found, held = [], [], 0
            if keys:
                yield hits(keys, found)

    return run


def _block_search(
    postings: Broadcast, k: int, shard: int, shards: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best terms of each query (qkey, tokens, weights) in one shard, with raw scores.

    A shard holds the terms whose number divided by ``shards`` leaves ``shard``; its postings count them from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched: PostingShard = postings.value
        for batch in batches:
            tokens, weights = batch.column(1), batch.column(2)
            ends = tokens.offsets.to_numpy()
            numbers, parts = tokens.values.to_numpy(), weights.values.to_numpy()
            starts = weights.offsets.to_numpy()
            found, sizes = [], [0]
            for lo, hi, at in zip(ends[:-1], ends[1:], starts):
                found.append(_best_of(*searched.candidates(numbers[lo:hi], parts[at : at + hi - lo], k), k))
                sizes.append(len(found[-1][0]))
            terms = np.concatenate([t for t, _ in found] or [np.empty(0, np.int64)]) * shards + shard
            scores = np.concatenate([x for _, x in found] or [np.empty(0)])
            hits = pa.StructArray.from_arrays([pa.array(terms, pa.int64()), pa.array(scores, pa.float64())], ["term_no", "score"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["qkey", "hits"])

    return run


def top_k(
    asked: DataFrame,
    index: TermIndex,
    k: int,
    broadcast_bytes: int = BROADCAST_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(qkey, hits): the best ``k`` terms of each query as an array of (rank, score, term_no).

    The postings are cut by term number into shards of a measured size that each task can hold; an index under
    the limit is one shard. A query is one row with its tokens; inside the task it visits posting blocks in the
    order of their bounds and stops when no other term can be among its best. Products and sums never become
    rows. Several shards are searched one after another over the same stored query weights, and each gives
    the ``k`` best terms of a query with raw scores.
    """
    weights = query_weights(asked, index, broadcast_bytes)
    shards = postings_shards(index, shard_bytes)
    per_query = _one_row_each(weights)
    if len(shards) == 1:
        return best_hits(_shard_hits(per_query, shards[0], index, k, 0, 1), k)
    per_query = write_stage(per_query, "query-weights")
    found = None
    for shard, postings in enumerate(shards):
        part = write_stage(_shard_hits(per_query, postings, index, k, shard, len(shards)), "shard-hits")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("qkey").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return best_hits(merged, k)


def _shared_shard(spark: SparkSession, postings: DataFrame, index: TermIndex, shard: int, shards: int) -> Broadcast:
    # At most ``shard_bytes`` pass through the driver, as they do for any broadcast.
    blocks = postings.toArrow().combine_chunks().to_batches()
    return spark.sparkContext.broadcast(PostingShard.of(blocks, -(-(index.n_terms - shard) // shards)))


def _shard_hits(per_query: DataFrame, postings: DataFrame, index: TermIndex, k: int, shard: int, shards: int) -> DataFrame:
    shared = _shared_shard(per_query.sparkSession, postings, index, shard, shards)
    return per_query.mapInArrow(_block_search(shared, k, shard, shards), f"qkey binary, hits {RAW_HIT_TYPE}")


def fill_zero_scores(hits: Column, k: int, n_terms: int) -> Column:
    """Complete a short hit list with the lowest term numbers that are not in it, at score 0.

    ``2k`` numbers always hold enough of them, so no join with the terms is needed.
    """
    wanted = min(k, n_terms)
    found = F.coalesce(hits, F.array().cast(HIT_TYPE))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(max(min(2 * k, n_terms), 1) - 1).cast("long"))
    free = F.array_except(numbers, F.transform(found, lambda h: h["term_no"]))
    extra = F.slice(free, F.lit(1), F.greatest(F.lit(wanted) - F.size(found), F.lit(0)))
    padded = F.transform(
        extra,
        lambda t, i: F.struct(
            (F.size(found) + i + 1).alias("rank"), F.lit(0.0).alias("score"), t.alias("term_no")
        ),
    )
    return F.concat(found, padded)


def retrieve_distinct(
    queries: DataFrame,
    index: TermIndex,
    k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(qkey, hits) for each distinct non-blank (query, field)."""
    best = top_k(distinct_queries(queries), index, k, broadcast_bytes, shard_bytes)
    return best.withColumn("hits", fill_zero_scores(F.col("hits"), k, index.n_terms))


def hydrate_hits(found: DataFrame, index: TermIndex, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(qkey, candidates): hits with id, label, synonyms, definition, parents and iri."""
    candidate = F.struct(
        "rank", "score", "id", "label", "synonyms", "definition", "parents", "iri"
    )
    # The outer form, as Spark would fill and rank the hits once more to test the number of a plain one.
    hits = found.select("qkey", F.inline_outer("hits")).filter(F.col("term_no").isNotNull())
    if index.terms_bytes <= broadcast_bytes:
        named = hits.join(F.broadcast(index.terms), "term_no")
    else:
        named = salted_join(hits, index.terms, ["term_no"], F.col("qkey"), "inner")
    return named.groupBy("qkey").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))


def retrieve(
    queries: DataFrame,
    index: TermIndex,
    k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
    shard_bytes: int = SHARD_BYTES,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Every input row with its ``candidates``; blank queries get an empty array.

    Rows of a query that more than ``salt_rows`` rows ask, and rows of blank queries, are dealt over
    salts by a hash of the row, so that none of them meet in one task.
    """
    found = retrieve_distinct(queries, index, k, broadcast_bytes, shard_bytes)
    candidates = hydrate_hits(found, index, broadcast_bytes)
    none = F.array().cast(candidates.schema["candidates"].dataType)
    text = strip_text(F.col("query"))
    keyed = queries.withColumn("qkey", F.when(text != "", query_key(text, F.col("field"))))
    hot = keyed.filter(F.col("qkey").isNotNull()).groupBy("qkey").count().filter(F.col("count") > salt_rows)
    hot = write_stage(hot.select("qkey", F.ceil(F.col("count") / F.lit(salt_rows)).cast("int").alias("salts")), "hot-queries")
    # At most one row for every ``salt_rows`` input rows.
    hot = broadcast_if_small(hot, hot.count() * 64, broadcast_bytes)
    row = F.xxhash64(*[c for c, t in queries.dtypes if "map<" not in t and "variant" not in t])
    salts = F.when(F.col("qkey").isNull(), BLANK_SALTS).otherwise(F.coalesce("salts", F.lit(1)))
    keyed = keyed.join(hot, "qkey", "left").withColumn("salt", F.pmod(row, salts).cast("int")).drop("salts")
    dealt = candidates.join(hot, "qkey", "left").select(
        "qkey", "candidates", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    )
    return (
        keyed.join(dealt, ["qkey", "salt"], "left")
        .withColumn("candidates", F.coalesce("candidates", none))
        .drop("qkey", "salt")
    )


def retrieve_for_concepts(
    concepts: DataFrame, index: TermIndex, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Candidates of every concept row."""
    return retrieve(concept_queries(concepts), index, k, broadcast_bytes).drop("query", "field")
