"""Counts decide what is broadcast, not the bytes of packed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.llm import prefix_trie as trie
from termloom.llm.common import join_groups
from termloom.plans.staging import write_stage
from tests.session import session


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_groups_over_the_limit_are_not_broadcast():
    spark = session()
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), "id").union(spark.sql("SELECT CAST(NULL AS LONG), -1L"))
    groups = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.sql("SELECT CAST(NULL AS LONG), 7L"))
    over, under = join_groups(rows, groups, ["k"], limit=20), join_groups(rows, groups, ["k"])
    got = sorted(over.collect(), key=str)
    # After the run, as adaptive execution may broadcast what turned out small.
    assert "BroadcastHashJoin" not in plan_of(over) and "SortMergeJoin" in plan_of(over)
    assert got == sorted(under.collect(), key=str) and len(got) == 201
    assert {r["v"] for r in got if r["id"] in (-1, 3, 45)} == {7, 6, None}


def test_the_trie_sends_no_table_of_conversations_or_nodes_through_the_driver():
    spark = session()
    rows = [(c, t, "user", f"t{t} c{c % 3}") for c in range(60) for t in range(3)]
    turns = write_stage(trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "turns")
    convs, made = trie.with_shared_heads(turns)
    # The only broadcast is the one of counted groups.
    assert made.count() == 180 and plan_of(made).count("BroadcastHashJoin") == 1
    report = trie.prefix_trie(convs, made)
    plain = report.collect()
    assert "BroadcastHashJoin" not in plan_of(report) and plan_of(report).count("SortMergeJoin") >= 2
    assert sum(r["n_convs"] for r in plain if r["depth"] == 3) == 60
