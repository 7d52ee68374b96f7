"""Analyzers, index and retrieval against plain Python on small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from termloom.functions.text import char_ngrams, strip_text, word_ngrams
from termloom.operators import index as I
from termloom.operators import retrieve as R
from termloom.operators.ontology import TERM_SCHEMA, number_terms

TEXTS = ["a bé cat  dog_2 x", "", "   ", "one", "中文 text ²", "x" * 40 + " 😀ab", "Don't\u00a0stop\u2003now", "a b"]
TERMS = [
    ("ROCK:412", "t/3", "Granitum album", ["granite", "granites", "white granite"], "", []),
    ("SEA:31", "t/1", "harbour mud flat", [], "A muddy tidal plain", []),
    ("SOIL:0028", "t/2", "soil crust sample", [], "Material scraped off the ground, e.g. lichen", []),
    ("ROCK:7", "t/4", "Basaltum nigrum", ["basalt", "basalts"], "", []),
    ("X:1", "t/5", "granite", ["Granite"], "", []),
    ("X:2", "t/6", "granary of the flat", [], "", []),
]
QUERIES = [("granite", "rock_found"), ("  GRANITE ", ""), ("harbour  mud flat", "place_kind"), ("zzz", ""),
           ("qqq www", "place"), ("", "place"), (" ", ""), (None, "place"), ("basalt lichen of a granite", "sample_title"), ("granite", "")]


def words_of(text):
    tokens = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def chars_of(text):
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return grams


def test_analyzers_equal_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", "t", word_ngrams(F.col("t")).alias("w"), char_ngrams(F.col("t")).alias("c"),
                     strip_text(F.col("t")).alias("s")).collect()
    for row in rows:
        assert Counter(row.w) == Counter(words_of(row.t))
        assert Counter(row.c) == Counter(chars_of(row.t)), row.t
        assert row.s == row.t.strip()


def brute_force(terms, query, field, k):
    """Dense scoring of one query, term by term."""
    def text(t):
        synonyms = " ; ".join(t[3])
        return f"{t[2]} {t[2]} {synonyms} {synonyms} {t[4]}"

    ordered = sorted(terms, key=lambda t: t[1])
    total = [0.0] * len(ordered)
    context = f"{field.replace('_', ' ')} {query}" if field else query
    for tokens_of, value_weight, context_weight in ((words_of, 0.45, 0.12), (chars_of, 0.35, 0.08)):
        docs = [Counter(tokens_of(text(t))) for t in ordered]
        df = Counter(token for doc in docs for token in doc)
        def vector(counts):
            raw = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in counts.items() if t in df}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            return {t: w / norm for t, w in raw.items()} if norm else {}
        vectors = [vector(doc) for doc in docs]
        for text_asked, weight in ((query, value_weight), (context, context_weight)):
            asked = vector(Counter(tokens_of(text_asked)))
            for i, v in enumerate(vectors):
                total[i] += weight * sum(w * v.get(t, 0.0) for t, w in asked.items())
    name = " ".join(query.lower().split())
    for i, t in enumerate(ordered):
        total[i] += any(" ".join(n.lower().split()) == name for n in [t[2], *t[3]])
    order = sorted(range(len(ordered)), key=lambda i: (-round(total[i], 9), i))[:k]
    return [(rank, round(total[i], 4), ordered[i][0]) for rank, i in enumerate(order, 1)]


def rows_of(found):
    return sorted(
        ((r.query, r.field, [(c.rank, c.score, c.id) for c in r.candidates]) for r in found.collect()), key=str
    )


def test_retrieval_equals_brute_force_with_one_and_many_shards(spark):
    index = I.build_index(number_terms(spark.createDataFrame(TERMS, TERM_SCHEMA)))
    queries = spark.createDataFrame(QUERIES, "query string, field string")
    for k in (1, 5, 9):
        small = rows_of(R.retrieve(queries, index, k))
        assert small == rows_of(R.retrieve(queries, index, k, broadcast_bytes=0, shard_bytes=index.postings_bytes // 2, salt_rows=2))
        for query, field, hits in small:
            asked = (query or "").strip()
            assert hits == (brute_force(TERMS, asked, field, k) if asked else []), (query, field)


def test_exact_name_ranks_first_and_unknown_tokens_are_filled(spark):
    index = I.build_index(number_terms(spark.createDataFrame(TERMS, TERM_SCHEMA)))
    queries = spark.createDataFrame([("white granite", ""), ("zzz", "")], "query string, field string")
    hits = {q: c for q, _, c in rows_of(R.retrieve(queries, index, 5))}
    assert hits["white granite"][0][2] == "ROCK:412" and hits["white granite"][0][1] > 1
    assert [(s, i) for _, s, i in hits["zzz"]] == [
        (0.0, "SEA:31"), (0.0, "SOIL:0028"), (0.0, "ROCK:412"), (0.0, "ROCK:7"), (0.0, "X:1")]


def test_hot_token_over_many_blocks_and_batches(spark):
    """One word in every term and every query; blocks, salts and Arrow batches all split it."""
    terms = [(f"T:{i}", f"t/{i:05}", f"common word{i % 7} n{i}", [], "", []) for i in range(1300)]
    index = I.build_index(number_terms(spark.createDataFrame(terms, TERM_SCHEMA)))
    assert index.postings.filter("token = 'common'").count() == 3
    queries = spark.range(60).select(
        F.when(F.col("id") < 20, "common").otherwise(F.concat(F.lit("common word"), F.col("id") % 7, F.lit(" n"), F.col("id"))).alias("query"),
        F.lit("").alias("field"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        arrays = rows_of(R.retrieve(queries, index, 4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shuffled = rows_of(R.retrieve(queries, index, 4, broadcast_bytes=0, shard_bytes=index.postings_bytes // 2, salt_rows=5))
    assert arrays == shuffled and len(arrays) == 60
    assert all(len(hits) == 4 for _, _, hits in arrays)


def test_plan_has_one_shuffle_before_scoring(spark):
    index = I.build_index(number_terms(spark.createDataFrame(TERMS, TERM_SCHEMA)))
    queries = spark.createDataFrame(QUERIES, "query string, field string")
    plan = R.top_k(R.distinct_queries(queries), index, 5)._jdf.queryExecution().executedPlan().toString()
    # The grouping of repeated queries and the spread of the distinct ones; none for grams.
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
