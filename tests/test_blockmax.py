"""Search over posting blocks against sums over all postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from termloom.operators.blockmax import PostingShard
from termloom.operators.retrieve import RANK_PLACES, _best_of, half_up


def made(rng, n_terms, n_tokens, per_token, levels=None):
    """(matrix of weights, shard); with ``levels`` weights repeat, so that sums tie."""
    held = np.zeros((n_terms, n_tokens))
    for token in range(n_tokens):
        some = rng.choice(n_terms, rng.integers(1, per_token + 1), replace=False)
        held[some, token] = rng.choice(levels, len(some)) if levels else rng.random(len(some)) ** 4 + 1e-3
    numbers, terms, weights = [], [], []
    for token in range(n_tokens):
        some = np.flatnonzero(held[:, token])
        for part in np.array_split(some, max(1, len(some) // 300)):
            order = part[np.lexsort((part, -held[part, token]))]
            numbers.append(token * 7)
            terms.append(order.astype(np.int64).tobytes())
            weights.append(held[order, token].tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(terms, pa.binary()), pa.array(weights, pa.binary())], ["token_no", "terms", "weights"])
    return held, PostingShard.of([batch.slice(0, 5), batch.slice(5)], n_terms)


def plain_best(held, tokens, weights, k):
    sums = held[:, tokens] @ weights
    order = np.lexsort((np.arange(len(sums)), -half_up(sums, RANK_PLACES)))[:k]
    return order[sums[order] > 0], sums


@pytest.mark.parametrize("levels", [None, (0.5, 0.25)])
@pytest.mark.parametrize("n_terms, per_token", [(50, 50), (5_000, 3_000)])
def test_same_terms_as_all_sums(levels, n_terms, per_token):
    rng = np.random.default_rng(2)
    held, shard = made(rng, n_terms, 40, per_token, levels)
    for _ in range(60):
        tokens = rng.choice(40, rng.integers(1, 15), replace=False)
        weights = rng.choice([0.25, 0.5, 1.0], len(tokens)) if levels else rng.random(len(tokens)) ** 3
        for k in (1, 5, 80):
            terms, sums = _best_of(*shard.search(tokens * 7, weights, k), k)
            want, exact = plain_best(held, tokens, weights, k)
            assert terms.tolist() == want.tolist()
            assert np.allclose(sums, exact[terms], atol=1e-12)


def test_a_clear_winner_leaves_most_postings_unvisited():
    rng = np.random.default_rng(3)
    held, shard = made(rng, 40_000, 30, 30_000)
    held[17] = 0
    total = int((held[:, :12] > 0).sum())
    # One token holds almost all of the weight of the query, the others are long lists of little weight.
    terms, _ = _best_of(*shard.search(np.arange(12) * 7, np.array([1.0, *[0.002] * 11]), 5), 5)
    assert terms.tolist() == plain_best(held, np.arange(12), np.array([1.0, *[0.002] * 11]), 5)[0].tolist()
    assert 0 < shard.visited < total / 20


def test_edges():
    held, shard = made(np.random.default_rng(4), 10, 6, 10)
    for tokens, weights in (([], []), ([-1, 1, 1000], [1.0, 1.0, 1.0]), ([0], [0.0])):
        terms, _ = _best_of(*shard.search(np.array(tokens, np.int64), np.array(weights, float), 3), 3)
        assert len(terms) == 0
    empty = PostingShard.of([], 4)
    assert len(empty.search(np.array([0]), np.array([1.0]), 2)[0]) == 0
