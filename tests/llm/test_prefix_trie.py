"""The conversation trie against a plain trie, with splits in and between tasks."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from termloom.llm import prefix_trie as trie
from termloom.plans.staging import write_stage

SCHEMA = "conv_id long, turn long, role string, text string, `range` string, depth int"


def plain(rows, rebuild):
    """Node report by a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:] if rebuild else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].split()) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), kids[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def make(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for turn in range(int(rng.integers(1, 7))):
            # A hot first turn, few second ones, then many.
            word = "hello there" if turn == 0 and rng.random() < 0.6 else f"w{rng.integers(0, 2 + turn)} x"
            rows.append((c, turn, "user" if turn % 2 == 0 else "bot", word, "r", 1))
    return rows


EDGES = [
    (1, None, None, None, "r", 1), (1, 3, "user", "", "r", 1), (2, None, "", "", "r", 1), (None, 1, "user", "lost", "r", 1),
    (5, 1, "user", "a b", "r", 1), (5, 1, "user", "a b", "r", 1), (5, 2, "bot", "c " * 30_000, "r", 1), (40, 1, "user", "a b", "r", 1),
    (41, 1, "user", "a b", "r", 1), (47, 1, "user", "only own", "r", 1), (63, 2, "x", "absent head", "r", 1), (5, 1, "bot", "tie", "r", 1),
]


@pytest.mark.parametrize("rows, task_nodes, rebuild", [(EDGES, 20_000, False), (EDGES, 4, True), (make(120), 60, False), ([], 5, True)])
def test_trie_against_plain_trie(spark, rows, task_nodes, rebuild):
    turns = write_stage(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)), "turns")
    parts = trie.with_shared_heads(turns) if rebuild else trie.as_they_are(turns)
    assert found(trie.prefix_trie(*parts, task_nodes=task_nodes)) == plain(rows, rebuild)


def test_one_conversation_of_most_turns(spark):
    rows = [(7, t, "user", f"turn {t}", "r", 1) for t in range(200)] + [(c, t, "user", f"turn {t}", "r", 1) for c in (3, 9) for t in range(40)]
    turns = write_stage(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)), "turns")
    got = found(trie.prefix_trie(*trie.as_they_are(turns), task_nodes=90))
    assert got == plain(rows, False)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_decomposition_sums_subtrees(shape):
    rng = np.random.default_rng(5)
    n = 700
    parent = {"chain": np.arange(n) - 1, "star": np.zeros(n, int) - (np.arange(n) == 0), "random": np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)]),
              "forest": np.array([-1 if i % 9 == 0 else int(rng.integers(i - i % 9, i)) for i in range(n)])}[shape]
    depth = np.zeros(n, np.int64)
    for v in range(n):
        depth[v] = 0 if parent[v] < 0 else depth[parent[v]] + 1
    values = rng.integers(0, 10**12, (n, 2))
    want = values.copy()
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            want[parent[v]] += want[v]
    assert (trie.decompose(parent, depth, values) == want).all()


def test_digest_of_many_ends_is_read_in_pieces(spark, monkeypatch):
    convs = spark.range(30_000).selectExpr("id * 3 - 200 AS conv_id", "0L AS length")
    paths = spark.createDataFrame([], "conv_id long, depth long, n1 long, n2 long, length long")
    got = trie.end_digests(convs, paths).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(str(i * 3 - 200) for i in range(30_000)).encode()).hexdigest()]
