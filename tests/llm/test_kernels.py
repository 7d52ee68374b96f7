"""Parts of the operators without Spark, against plain versions."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm.ann import perturbations
from termloom.llm.common import encoder, split_words, word_codes
from termloom.llm.jaccard_join import BandHasher, choose_bands, gram_sets, linked_pairs
from termloom.llm.license_scan import TEMPLATES, Scanner, align
from termloom.llm.packing import Packer
from termloom.llm.queries import tokenizer_path
from termloom.llm.reshard import plan_transfers
from termloom.llm.suffix_dedup import minimisers
from termloom.llm.training_order import feistel


@given(st.lists(st.text(alphabet="abC dEé́\tΣ'sİ.,<|>\n\x0b!123½ßﬁ한\x1c\x85🙂²ªʰ", max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers_own(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(tokenizer_path(), 1).column(pa.array(texts, pa.string()))]
    assert got == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_special_tokens_keep_their_case():
    texts = ["<|endoftext|>", "<|ENDOFTEXT|>.", "a<|endoftext|>.,"]
    test_ids_are_the_tokenizers_own.hypothesis.inner_test(texts)


def test_word_codes_follow_words():
    texts = [None, "", "  ", "a b\ta", " b", "a\x1cb"]
    codes = list(word_codes(pa.array(texts)))
    assert [len(c) for c in codes] == [len(split_words(t)) for t in texts]
    assert codes[3][0] == codes[3][2] != codes[3][1] == codes[4][0]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    assert sorted(feistel(np.arange(size), size, 5).tolist()) == list(range(size))
    assert size < 10 or feistel(np.arange(size), size, 5).tolist() != feistel(np.arange(size), size, 6).tolist()


@given(st.lists(st.integers(1, 5000), max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing_keeps_every_token_once(lengths):
    packer = Packer(2048, 1 / 64)
    rows = [r for i, n in enumerate(lengths) for r in packer.add(i, n)] + list(packer.finish())
    for i, n in enumerate(lengths):
        mine = sorted((start, length) for doc, start, length, _, _ in rows if doc == i)
        assert mine[0][0] == 0 and sum(length for _, length in mine) == n
        assert all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:]))
    for _, bin_ in itertools.groupby(sorted(rows, key=lambda r: (r[3], r[4])), key=lambda r: r[3]):
        at = 0
        for _, _, length, _, offset in bin_:
            assert offset == at
            at += length
        assert at <= 2048


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 3), st.integers(1, 4)), min_size=1, max_size=6), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_transfers_move_the_fewest_bytes(blocks, shards):
    blocks = [(o, k, n, n * 2**k) for (o, k), n in {(o, k): n for o, k, n in blocks}.items()]
    plan = plan_transfers(blocks, shards)
    rows = [(o, k) for o, k, n, _ in sorted(blocks) for _ in range(n)]
    for o, k, n, _ in blocks:
        spans = sorted((lo, hi) for a, b, lo, hi, _, _ in plan if (a, b) == (o, k))
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    counts = [sum(hi - lo for *_, lo, hi, s, _ in plan if s == shard) for shard in range(shards)]
    assert max(counts) - min(counts) <= 1
    moved = sum((hi - lo) * 2**k for o, k, lo, hi, s, _ in plan if s != o)
    floor, extra = divmod(len(rows), shards)
    best = None
    for more in itertools.combinations(range(shards), extra):
        cost = 0
        for old in {o for o, _ in rows}:
            room = floor + (old in more) if old < shards else 0
            cost += sum(sorted(2**k for o, k in rows if o == old)[: max(0, sum(o == old for o, _ in rows) - room)])
        best = cost if best is None else min(best, cost)
    assert moved == best


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdefgh"), max_size=20))
@settings(max_examples=200, deadline=None)
def test_alignment_rises_and_matches(a, b):
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(a, b)


def test_every_template_is_found_in_noise():
    rng = random.Random(4)
    scanner = Scanner(TEMPLATES, 0.8)
    noise = lambda n: " ".join(rng.choice("the of and to in work version use") for _ in range(n))
    for name, text in TEMPLATES.items():
        found = scanner.scan(f"{noise(300)} {text} {noise(50)} {text.upper()} {noise(40)}")
        assert [f[0] for f in found] == [name, name], name
        assert all(f[1] == 1.0 for f in found)
        words = text.split()
        cut = [w for i, w in enumerate(words) if i % 11 != 5]
        assert name in [f[0] for f in scanner.scan(" ".join(cut))] or len(cut) < 8
    assert scanner.scan(noise(3000)) == []


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    hasher = BandHasher(bands, rows)
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (164, 20, 20))
        met += bool((hasher(np.append(both, a)) == hasher(np.append(both, b))).any())
    assert met == 200


def test_pair_counts_agree_both_ways():
    rng = random.Random(3)
    for n, pool in ((5, 30), (60, 40), (60, 4000)):
        sets = [{rng.randrange(pool) for _ in range(rng.randrange(1, 30))} for _ in range(n)]
        sets[1] = set(sets[0])
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), sizes)
        grams = np.concatenate([np.array(sorted(s), dtype=np.uint64) for s in sets])
        wanted = np.triu(np.ones((n, n), bool), 1)
        got = linked_pairs(sizes, owner, grams, wanted, Fraction(4, 5))
        want = [[wanted[i, j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
        assert (got == np.array(want)).all()


def test_short_texts_are_one_gram():
    a, b, c, d = gram_sets(pa.array(["one two", "one  two\n", "one two three four five six", None]), 5)
    assert len(a) == 1 and a[0] == b[0] and len(c) == 2 and len(d) == 0


def test_equal_passages_select_equal_places():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 2**63, 50, dtype=np.uint64)
    a = np.concatenate([rng.integers(0, 2**63, 70, dtype=np.uint64), passage])
    b = np.concatenate([rng.integers(0, 2**63, 9, dtype=np.uint64), passage, rng.integers(0, 2**63, 80, dtype=np.uint64)])
    at_a, at_b = minimisers(a)[0] - 70, minimisers(b)[0] - 9
    assert set(at_a[(at_a >= 0) & (at_a <= 40)]) & set(at_b[(at_b >= 0) & (at_b <= 40)])
    assert len(minimisers(passage[:49])[0]) == 0


def test_perturbations_rise_and_never_cross_both_sides():
    sets = perturbations(4, 40)
    assert sets[0] == () and len(set(sets)) == 40
    assert all(7 - c not in s for s in sets for c in s)
