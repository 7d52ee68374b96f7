"""Folding, matching and learning of the toxicity lexicon."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import toxicity as tox
from termloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, score double, `row` string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    "text, want",
    [("An 1D10T!", "an idiot!"), ("$tup1d, 100 $", "stupid, 100 $"), ("іdіоt", "idiot"), ("m​oron", "moron"), ("ｌｏｓｅｒ", "loser"),
     ("the$$$ 2024", "the$$$ 2024"), ("Schön chóna", "schön chóna"), ("", "")],
)
def test_fold(text, want):
    assert tox.fold(text) == want


def brute(scorer, text):
    """Hits by trying every entry at every place."""
    spared, found = [], {}
    for start in range(len(text)):
        if start and text[start - 1].isalnum():
            continue
        for phrase in scorer.exceptions:
            end = start + len(phrase)
            if text.startswith(phrase, start) and not text[end : end + 1].isalnum():
                spared.append((start, end))
        for entry, weight in scorer.lexicon.items():
            end = start + len(entry) - 1
            closed = not text[end : end + 1].isalnum()
            if text.startswith(entry[1:], start) and (entry[0] == "^" or closed) and weight > found.get(start, (0, 0))[1]:
                found[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in spared)]


def test_hits_against_every_place():
    rng = random.Random(4)
    scorer = tox.Scorer({"=ab": 2.0, "^ab": 1.0, "^abc": 3.0, "=b": 1.5, "^ca": 2.5}, ["ab b", "ca"], [0.0, 1.0, 1.0])
    for _ in range(500):
        text = "".join(rng.choice("abc  .") for _ in range(rng.randrange(40)))
        assert scorer.hits(text) == brute(scorer, text)


def rows():
    clean = [f"plain words about gardens number{i} and trash can day" for i in range(60)]
    toxic = [f"you zonk{'aeiou'[i % 5]}b and grumfle person number{i}" for i in range(40)]
    docs = [(i, t, "en", "s", 0.5, "r") for i, t in enumerate(clean + toxic)]
    labels = [(i, 1, int(i >= 60)) for i in range(100)]
    return docs, labels


def test_learns_words_and_beginnings(spark):
    docs, labels = rows()
    edges = [(None, "a grumfle", None, None, 0.1, "r"), (200, None, None, "s", 0.1, "r"), (201, "", "en", "s", 0.1, "r"), (202, "x " * 200_000 + "grumfle", "en", "s", 0.1, "r"),
             (203, "GRUMFL3 z0nkaxx zonkiyy", "xx", "t", 0.1, "r"), docs[3], docs[3]]
    frame = spark.createDataFrame(docs + edges, SCHEMA)
    extra = [(3, 1, None), (None, 1, 1), (7, 1, 0), (999, 0, 1)]
    scorer = tox.fit(frame, spark.createDataFrame(labels + extra, LABELS))
    assert "=grumfle" in scorer.lexicon and any(e.startswith("^zonk") for e in scorer.lexicon) and not any("trash" in e for e in scorer.lexicon)
    got = tox.toxicity_report(frame, spark.createDataFrame(labels + extra, LABELS)).collect()
    assert len(got) == len(docs) + len(edges)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].predicted == (i >= 60) for i in range(100))
    assert by_id[200].score == by_id[201].score < 0.3 and by_id[203].predicted == 1 and not by_id[None].held_out
    # A word in a long text weighs less than in a short one.
    assert by_id[202].score < by_id[None].score


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = rows()
    frame = spark.createDataFrame(docs, SCHEMA)
    changed = frame.withColumns({"lang": F.lit("zz"), "source": F.lit("other")})
    flipped = spark.createDataFrame(labels, LABELS).withColumn("toxic", F.when(tox.in_hold_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = tox.toxicity_report(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(a) == sorted(tox.toxicity_report(changed, flipped).collect())


def test_empty_tables_and_one_kind_of_label(spark):
    docs, labels = rows()
    none = spark.createDataFrame([], LABELS)
    assert tox.toxicity_report(spark.createDataFrame([], SCHEMA), none).count() == 0
    assert {r.predicted for r in tox.toxicity_report(spark.createDataFrame(docs, SCHEMA), none).collect()} == {0}
    one = spark.createDataFrame([r for r in labels if r[2] == 0], LABELS)
    assert {r.predicted for r in tox.toxicity_report(spark.createDataFrame(docs, SCHEMA), one).collect()} == {0}


def test_clashing_columns_stay(spark):
    docs, _ = rows()
    got = tox.score_toxicity(spark.createDataFrame(docs, SCHEMA), tox.Scorer({"=grumfle": 3.0}, [], [-2.0, 1.0, 1.0]))
    assert got.columns == ["doc_id", "lang", "source", "score", "row", "_score"] and got.filter("score = 0.5").count() == 100


def test_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op13_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    found = {(r.toxic, r.predicted): r["n"] for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    caught, missed, false, left = (found.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert caught / (caught + missed) >= 0.9 and false / (false + left) <= 0.02
