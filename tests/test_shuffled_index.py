"""The query of the shuffled index: every row asks, and its busy queries are salted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termloom.catalog import retrieval
from termloom.operators import index as I
from termloom.operators import retrieve as R
from termloom.operators.ontology import number_terms

LINES = "granite rock\n harbour mud\n\n granite rock \nsoil crust"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    talks = [(c, t, role, LINES) for c in range(4) for t, role in enumerate(("user", "bot", None))] + [(None, 9, "user", "only once"), (9, 0, "user", None)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(k, "mud flat", "B#1") for k in range(3)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{d}/part.parquet")
    texts = ["granite and basalt", "harbour mud flat", "soil crust", "only sand", "granite rock soil"] + [f"filler mud {i}" for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_busy_queries_are_salted_and_answered_as_without(spark, folder, monkeypatch):
    stages = {}
    write = R.write_stage

    def kept(df, name, *a):
        stages[name] = write(df, name, *a)
        return stages[name]

    monkeypatch.setattr(R, "write_stage", kept)
    got = rows_of(retrieval.retrieve_shuffled(spark, folder))
    # Each of three lines and fields has 4 or 8 rows; the part label has 3.
    assert sorted(r["salts"] for r in stages["hot-queries"].collect()) == [3] + [4] * 6 + [8] * 3
    index = I.build_index(number_terms(retrieval.benchmark_terms(spark, folder)))
    plain = R.retrieve(R.distinct_queries(retrieval.all_asked(spark, folder)).select("query", "field"), index, k=8)
    assert got == rows_of(retrieval._flat(plain, "query", "field")) and len(got) == 8 * 11


def test_a_row_that_lost_its_candidates_shows(spark, folder, monkeypatch):
    retrieve = R.retrieve
    none = F.expr("filter(candidates, c -> false)")
    monkeypatch.setattr(
        R, "retrieve", lambda *a, **k: retrieve(*a, **k).withColumn("candidates", F.when(F.col("asks") == "2/1/0", none).otherwise(F.col("candidates")))
    )
    asked = {(r["query"], r["field"]) for r in retrieval.retrieve_shuffled(spark, folder).collect()}
    assert ("granite rock", "bot") not in asked and len(asked) == 10
