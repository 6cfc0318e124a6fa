"""FM-index over runs of integer symbols: backward search by wavelet ranks, locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of symbols >= 1 in which every 0 ends a run.

    Suffixes compare up to their run's 0 and then by position, so no comparison passes a run's end: as many symbols
    as fit 64 bits are compared first, then twice as many by the ranks of what follows, in as many rounds as the logarithm
    of the longest repeat; only suffixes that still tie are sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    width = 64 // bits
    last = np.uint64((1 << bits) - 1)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    live = np.ones(n, bool)
    for i in range(width):
        symbol = np.where(live, padded[i : i + n], 0)
        key = key << np.uint64(bits) | symbol
        live &= symbol != 0
    order = np.argsort(key, kind="stable")
    depth = width
    sorted_key = key[order]
    group = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    # ties with a 0 among the compared symbols are settled by position; the others differ further on, and what follows
    # them is ranked already: every round compares twice as many symbols
    starts = np.flatnonzero(group)
    open_ = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n))) & ((sorted_key & last) != 0)
    group |= ~open_
    rank = np.zeros(n + 1, np.int64)
    while True:
        rank[order] = np.maximum.accumulate(np.where(group, np.arange(n), 0))
        sizes = np.diff(np.append(np.flatnonzero(group), n))
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(at):
            return order
        label, follows = rank[order[at]], rank[np.minimum(order[at] + depth, n)]
        again = np.lexsort((order[at], follows, label))
        order[at], follows = order[at][again], follows[again]
        group[at] |= np.concatenate([[True], (follows[1:] != follows[:-1]) | (label[1:] != label[:-1])])
        depth *= 2


class Wavelet:
    """Ranks of symbols in a sequence: one bit per level, counts before every position."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.n = bits, len(sequence)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = sequence.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = (level >> b & 1).astype(np.int32)
            count = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[k] before position i[k]."""
        low = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            count, zeros = self.ones[level], self.zeros[level]
            a, b = count[low], count[i]
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return i - low


class FmIndex:
    """Index of one shard. ``text``: symbols >= 1, every run ended by a 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        self.text_len = n = len(text)
        order = suffix_order(text)
        self.bwt = text[order - 1].astype(np.int64) if n else np.zeros(0, np.int64)
        counts = np.bincount(text, minlength=alphabet + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree = Wavelet(self.bwt, max(1, int(alphabet).bit_length()))
        keep = (order % sample == 0) | (self.bwt == 0)
        self.mark = np.concatenate([[0], np.cumsum(keep)])
        self.kept = order[keep]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns: one row each, its ``lengths`` symbols right-aligned, none of them 0."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.text_len, np.int64)
        width = patterns.shape[1]
        for step in range(1, width + 1):
            on = np.flatnonzero((lengths >= step) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, width - step]
            base = self.before[symbol]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[on], high[on]]))
            low[on] = base + both[: len(on)]
            high[on] = base + both[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back until a sampled rank (or the start of a run, sampled too)."""
        at = rows.astype(np.int64).copy()
        steps = np.zeros(len(at), np.int64)
        out = np.empty(len(at), np.int64)
        active = np.arange(len(at))
        while len(active):
            here = at[active]
            known = self.mark[here + 1] > self.mark[here]
            done = active[known]
            out[done] = self.kept[self.mark[at[done]]] + steps[done]
            active = active[~known]
            symbol = self.bwt[at[active]]
            at[active] = self.before[symbol] + self.tree.rank(symbol, at[active])
            steps[active] += 1
        return out
