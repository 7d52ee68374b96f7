"""Entries of canonical records are made once."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from termloom.operators import canonical as C
from tests.session import session


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_made_once_and_rows_without_any_are_left_out():
    spark = session()
    rows = spark.createDataFrame([(1, ["a", "a", "b"], 1.5), (2, None, None), (2, ["c"], None), (None, [""], 2.0)], "id long, kinds array<string>, x double")
    for columns in (["kinds", "x"], ["x"]):
        entries = C.metadata_entries(C.canonicalise(rows, keep=["id"], columns=columns), "id")
        assert plan_of(entries).count("map_from_entries") == 1
        found = Counter((r["id"], r["key"], r["value"]) for r in entries.collect())
        kinds = {(1, "kinds", "a | b"): 1, (2, "kinds", "c"): 1} if "kinds" in columns else {}
        assert found == {(1, "x", "1.5"): 1, (None, "x", "2.0"): 1, **kinds}


def test_merged_entries_are_read_once():
    spark = session()
    entries = F.expr("transform(sequence(1, n), i -> named_struct('key', concat('k', i % 2), 'value', string(i)))")
    rows = spark.createDataFrame([(3,), (2,)], "n int").select(C.merge_repeated(entries).alias("m"))
    assert plan_of(rows).count("sequence(") == 1
    assert [[tuple(e) for e in r["m"]] for r in rows.collect()] == [[("k0", "2"), ("k1", "1 | 3")], [("k0", "2"), ("k1", "1")]]
