"""Exact top-k search over posting blocks that state their largest weight.

The postings of a token lie in slices of falling weight. A query visits slices in the order of their bound,
query weight times largest weight. What a term that was not met yet can still reach is the sum of the
largest bounds left per token; once that is below the k-th best sum, no new term can enter, and the terms
that still may are summed exactly from their own token lists. Sums are kept for the terms met, not for all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE = 64
# Postings of the first round; each further round visits twice as many before it looks at the bound.
FIRST_ROUND = 512
# Up to so many postings in all, a query is scored whole: rounds and bounds cost more than they spare.
WHOLE = 65_536
# Ranks compare sums rounded to nine places, so a sum counts as below another only beyond this.
MARGIN = 2e-9


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


def unpacked(packed: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all numbers of a column of packed blocks; a null block is empty."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    numbers = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // 8, offsets[0]) if data else np.empty(0, kind)
    return np.diff(offsets) // 8, numbers


@dataclass
class PostingShard:
    """Postings of a range of terms, by token in slices and by term."""

    tokens: np.ndarray
    first_slice: np.ndarray
    slice_start: np.ndarray
    slice_size: np.ndarray
    slice_top: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    first_of_term: np.ndarray
    term_tokens: np.ndarray
    term_weights: np.ndarray
    postings_before: np.ndarray
    visited: int = 0
    _query: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, blocks: list[pa.RecordBatch], n_terms: int) -> PostingShard:
        """From blocks (token_no, terms, weights) whose weights fall from the first to the last."""
        numbers = np.concatenate([b.column(0).to_numpy() for b in blocks] or [np.empty(0, np.int64)])
        lists = [unpacked(b.column(1), np.int64) for b in blocks]
        lengths = np.concatenate([n for n, _ in lists] or [np.empty(0, np.int64)]).astype(np.int64)
        terms = np.concatenate([t for _, t in lists] or [np.empty(0, np.int64)]).astype(np.int32)
        weights = np.concatenate([unpacked(b.column(2), np.float64)[1] for b in blocks] or [np.empty(0)])
        tokens, place = np.unique(numbers, return_inverse=True)
        slices = -(-lengths // SLICE)
        owner = np.repeat(np.arange(len(lengths)), slices)
        within = ranges(np.zeros(len(lengths), np.int64), slices)
        starts = (np.cumsum(lengths) - lengths)[owner] + within * SLICE
        order = np.argsort(place[owner], kind="stable")
        by_term = np.argsort(terms, kind="stable")
        return cls(
            tokens=tokens,
            first_slice=np.searchsorted(place[owner][order], np.arange(len(tokens) + 1)),
            slice_start=starts[order],
            slice_size=np.minimum(lengths[owner] - within * SLICE, SLICE)[order],
            slice_top=weights[starts[order]] if len(starts) else np.empty(0),
            terms=terms,
            weights=weights,
            first_of_term=np.searchsorted(terms[by_term], np.arange(n_terms + 1)),
            term_tokens=np.repeat(place, lengths).astype(np.int32)[by_term],
            term_weights=weights[by_term],
            postings_before=np.concatenate([[0], np.cumsum(np.bincount(place, lengths, len(tokens)))]),
        )

    def _sums(self, terms: np.ndarray, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole sums of some terms, from their token lists."""
        if self._query is None:
            self._query = np.zeros(len(self.tokens))
        self._query[found] = weights
        starts = self.first_of_term[terms]
        sizes = self.first_of_term[terms + 1] - starts
        at = ranges(starts, sizes)
        products = self._query[self.term_tokens[at]] * self.term_weights[at]
        self._query[found] = 0.0
        return np.bincount(np.repeat(np.arange(len(terms)), sizes), products, minlength=len(terms))

    def scores(self, tokens: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, sums) of all terms that hold one of the tokens."""
        if not len(self.tokens):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        known = self.tokens[at] == tokens
        found, weights = at[known], weights[known]
        counts = self.first_slice[found + 1] - self.first_slice[found]
        slices = ranges(self.first_slice[found], counts)
        place = ranges(self.slice_start[slices], self.slice_size[slices])
        products = np.repeat(np.repeat(weights, counts), self.slice_size[slices]) * self.weights[place]
        terms = self.terms[place]
        if len(self.first_of_term) > 4 * len(terms):
            met, back = np.unique(terms, return_inverse=True)
            return met, np.bincount(back, products)
        met = np.flatnonzero(np.bincount(terms))
        return met, np.bincount(terms, products)[met]

    def candidates(self, tokens: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`search`; a query of few postings is summed whole."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), max(len(self.tokens) - 1, 0))
        held = self.postings_before[at + 1] - self.postings_before[at] if len(self.tokens) else np.zeros(1)
        # Tokens that the shard lacks count as well, so this is at most too large.
        return self.scores(tokens, weights) if held.sum() <= WHOLE else self.search(tokens, weights, k)

    def search(self, tokens: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, sums) that hold the best ``k`` terms with a positive sum, and all that tie with them."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), max(len(self.tokens) - 1, 0))
        known = (self.tokens[at] == tokens) & (weights > 0) if len(self.tokens) else np.zeros(len(tokens), bool)
        found, weights = at[known], weights[known]
        counts = self.first_slice[found + 1] - self.first_slice[found]
        slices, owner = ranges(self.first_slice[found], counts), np.repeat(np.arange(len(found)), counts)
        bounds = weights[owner] * self.slice_top[slices]
        order = np.argsort(-bounds, kind="stable")
        slices, owner, bounds = slices[order], owner[order], bounds[order]
        sizes = self.slice_size[slices]
        upto = np.cumsum(sizes)
        met, sums = np.empty(0, np.int64), np.empty(0)
        done, visited, wanted, least, left = 0, 0, FIRST_ROUND, 0.0, 0.0
        while done < len(slices):
            stop = min(int(np.searchsorted(upto, visited + wanted)) + 1, len(slices))
            here = slices[done:stop]
            place = ranges(self.slice_start[here], sizes[done:stop])
            products = np.repeat(weights[owner[done:stop]], sizes[done:stop]) * self.weights[place]
            met, back = np.unique(np.concatenate([met, self.terms[place]]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, products]))
            done, visited, wanted = stop, int(upto[stop - 1]), 2 * wanted
            if done == len(slices):
                break
            # Slices are in order, so a token's first one left has its largest bound.
            left = bounds[done:][np.unique(owner[done:], return_index=True)[1]].sum()
            if len(met) >= k:
                least = np.partition(sums, len(sums) - k)[len(sums) - k]
                if left + MARGIN < least:
                    break
        self.visited += visited
        if done < len(slices):
            met = met[sums + left >= least - MARGIN]
            sums = self._sums(met, found, weights)
        return met, sums
