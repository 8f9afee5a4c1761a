"""An FM-index over word numbers: suffix array, wavelet matrix, backward search, sampled locate. All vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of ``seq`` in order, by prefix doubling; each 0 is a separator of its own, ordered by place."""
    n = len(seq)
    rank = seq.astype(np.int64)
    zero = seq == 0
    seps = int(zero.sum())
    rank[zero] = np.arange(seps)
    rank[~zero] += seps
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        # ranks that are unique already keep their place; the pair sorts the rest
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = key
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often c is among the first i values."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = []
        for level in reversed(range(max(1, int(top).bit_length()))):
            bit = (seq >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
            zeros = len(seq) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for level, ones, zeros in self.levels:
            bit = ((c >> level) & 1).astype(bool)
            i = np.where(bit, zeros + ones[i], i - ones[i])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return i - low


class FMIndex:
    """Index of a sequence of word numbers in which 0 separates runs; the sequence begins with 0."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray, top: int):
        self.n = len(seq)
        order = suffix_array(seq)
        before = seq[order - 1]  # the first is followed, as in a ring, by the last
        self.bwt = before
        self.wavelet = WaveletMatrix(before.astype(np.int64), top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1)))).astype(np.int64)
        # each SAMPLE-th position is kept, and each first position of a run, so that no step crosses a separator
        kept = (order % self.SAMPLE == 0) | (before == 0)
        self.kept = kept
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept_at = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: rows of word numbers, right-aligned, -1 in front. Gives for each row its range of suffixes."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            live = np.flatnonzero((patterns[:, j] >= 0) & (lo < hi))
            if not len(live):
                continue
            c = patterns[live, j]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps back to the next sampled one."""
        at = np.full(len(rows), -1, np.int64)
        rows, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            found = self.kept[rows]
            at[open_[found]] = self.kept_at[self.kept_before[rows[found]]] + steps
            rows, open_ = rows[~found], open_[~found]
            c = self.bwt[rows].astype(np.int64)
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return at
