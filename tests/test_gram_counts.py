"""Character grams counted by distinct words."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.text import char_ngrams
from termloom.operators import index as I
from tests.session import session


def test_character_grams_are_counted_by_distinct_words():
    spark = session()
    texts = ["Aa bb  aa x", "aa", "", None, " \t ", "Ä\U0001f600z aa\nbb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = df.select(F.explode(char_ngrams(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counted = I.char_gram_counts(df)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))
    assert counted.dtypes == plain.dtypes
