"""Divergences of sources against plain whole numbers, over cells of any size."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from termloom.llm import divergence as div

SCHEMA = "doc_id long, text string, lang string, source string, term string, block long, p string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top):
    docs = [tuple(x or "" for x in r[1:4]) for r in rows]
    texts = [(lang, source, [t.translate(SMALL) for t in TERM.findall(text)]) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in texts}:
        df = Counter(t for x in texts if x[0] == lang for t in set(x[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = defaultdict(Counter)
        for x in texts:
            if x[0] == lang:
                counts[x[1]].update(t for t in x[2] if df[t] >= 3)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        for s in counts:
            found = {"pair": [], "term": []}
            for o in counts:
                if o != s:
                    found["pair"].append((sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o))
            found["term"] = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def made():
    words = ["Alpha", "beta9gamma", "delta", "éclair", "Ünder", "zeta-eta", "THETA", "iota_k", "日本", "x"]
    rows = []
    for i in range(60):
        text = " ".join(words[(i * k + k * k) % len(words)] for k in range(1 + i % 17))
        rows.append((i, text, "en" if i % 4 else "de", f"s{i % 7}", "t", 1, "p"))
    rows += [(100, None, None, None, "t", 1, "p"), (101, "", "en", "empty", "t", 1, "p"), (102, "12 34 _ [", "en", "blank", "t", 1, "p"),
             (103, "alpha " * 50_000, "en", "s1", "t", 1, "p"), (104, "only one", "fr", "a", "t", 1, "p"), (105, "only two", "fr", "b", "t", 1, "p"),
             (106, "solo solo", "it", "a", "t", 1, "p"), (107, None, "", "", "t", 1, "p"), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("group_block, term_block, top", [(16, 16_384, 200), (2, 3, 4), (1, 1, 200)])
def test_against_whole_numbers(spark, group_block, term_block, top):
    df = spark.createDataFrame(made(), SCHEMA).repartition(4)
    got = div.source_divergence(df, top=top, group_block=group_block, term_block=term_block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(made(), top)


def test_empty_table(spark):
    assert div.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
