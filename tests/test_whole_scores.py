"""Scores summed in arrays, and query tokens made once."""

from __future__ import annotations

import numpy as np

from termloom.operators import index as I
from termloom.operators import retrieve as R
from termloom.operators.ontology import number_terms
from tests.session import session


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def terms_of(spark, *labels):
    rows = [(f"T:{i}", f"t/{i:04d}", label, [], "", []) for i, label in enumerate(labels)]
    return number_terms(spark.createDataFrame(rows, "id string, iri string, label string, synonyms array<string>, definition string, parents array<string>"))


def test_query_tokens_are_made_once():
    spark = session()
    index = I.build_index(terms_of(spark, "red ring", "blue bolt"))
    asked = R.distinct_queries(spark.createDataFrame([("red", "f")], "query string, field string"))
    assert "size(concat(transform" not in plan_of(R.query_weights(asked, index))


def test_scores_summed_in_arrays_equal_joined_products(monkeypatch):
    spark = session()
    index = I.build_index(terms_of(spark, "red ring", "red ring", "blue bolt", "small blue ring", "nut"))
    queries = [("red ring", ""), ("RED  ring", "part_name"), ("blue", "f"), ("zzz qqq", ""), (" ", ""), (None, "f"), ("ring bolt", None)]
    asked = R.distinct_queries(spark.createDataFrame(queries * 2, "query string, field string"))

    def rows(df):
        return sorted((bytes(r[0]), -1 if r[1] is None else r[1], r[2] is None or round(r[2], 9)) for r in df.collect())

    joined = rows(R.score_terms(asked, index, broadcast_bytes=0))
    summed = R.score_terms(asked, index)
    assert "Join" not in plan_of(summed).split("MapInArrow")[0]
    assert rows(summed) == joined
    monkeypatch.setattr(R, "SHARD_BYTES", index.postings_bytes // 2)
    monkeypatch.setattr(R, "BATCH_SCORES", 2)
    assert rows(R.score_terms(asked, index)) == joined


def test_few_postings_are_summed_without_rounds():
    spark = session()
    index = I.build_index(terms_of(spark, *[f"red ring {i}" for i in range(40)]))
    blocks = index.postings.select("token_no", "terms", "weights").toArrow().combine_chunks().to_batches()
    shard = R.PostingShard.of(blocks, index.n_terms)
    tokens, weights = shard.tokens[:7], np.linspace(0.1, 1, 7)
    few, whole = (R._best_of(*f(tokens, weights, 5), 5) for f in (shard.candidates, shard.search))
    assert few[0].tolist() == whole[0].tolist() and np.allclose(few[1], whole[1], atol=1e-12)
