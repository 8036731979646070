"""An FM-index over word numbers: suffix array, wavelet matrix with popcount ranks, backward search, sampled positions.

Symbol 0 is a separator.  Separators count as different from each other, in
order of place, so that no match crosses one and comparing suffixes ends there.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    m = len(separators)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[separators] = np.arange(m)
    rest = np.flatnonzero(text)
    order = rest[np.argsort(text[rest], kind="stable")]
    key = text[order]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    slots = np.arange(len(order))
    rank[order] = m + np.maximum.accumulate(np.where(new[:-1], slots, 0))
    k = 1
    tied = np.flatnonzero(~(new[:-1] & new[1:]))
    while len(tied):
        sub = order[tied]
        both = rank[sub] * (n + 2) + rank[np.minimum(sub + k, n)] + 1
        by = np.argsort(both, kind="stable")
        sub, both = sub[by], both[by]
        order[tied] = sub
        fresh = np.ones(len(sub), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[tied] = fresh
        rank[sub] = m + np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & new[tied + 1])]
        k *= 2
    return np.concatenate([separators, order])


class WaveletMatrix:
    """Ranks of symbols in a sequence; each level is a bit vector with 64-bit words and counts before them."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n, self.levels = len(sequence), max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        seq = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            seq = np.concatenate([seq[~bit], seq[bit]])
            self.zeros.append(self.n - int(self.before[-1][-1]))
        every = np.arange(symbols)
        self.start = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._walk(symbol, at) - self.start[symbol]


class FMIndex:
    #: Every so many places a suffix has its position kept, and so has each that follows a separator.
    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` has numbers below ``symbols``."""
        suffixes = suffix_array(text)
        self.bwt = np.where(suffixes > 0, text[suffixes - 1], 0)
        self.ranks = WaveletMatrix(self.bwt, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.sampled = (self.bwt == 0) | (suffixes % self.SAMPLE == 0)
        self.samples = suffixes[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of ``phrases`` (none has a separator) that occur: their numbers and ranges of suffixes."""
        which = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.before[last], self.before[last + 1]
        for j in range(phrases.shape[1] - 1, -1, -1):
            if j < phrases.shape[1] - 1:
                c = phrases[which, j]
                low, high = self.before[c] + self.ranks.rank(c, low), self.before[c] + self.ranks.rank(c, high)
            there = low < high
            which, low, high = which[there], low[there], high[there]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: steps backward until one has its position kept."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.samples[self.sample_at[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.ranks.rank(c, at)
            steps += 1
        return out
