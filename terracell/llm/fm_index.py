"""An FM-index over word ids: backward search through wavelet-matrix ranks, positions from samples."""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Index of runs of word ids (1 and up), each run closed by a 0.

    Terminators sort before all words and, among themselves, by position, so no comparison passes the end of
    a run and every run start is a sampled position.
    """

    def __init__(self, text: np.ndarray, step: int = 8):
        """text: int array that ends in 0 (or is empty); every step-th position of a run is sampled."""
        self.n = n = len(text)
        text = text.astype(np.int64)
        ends = np.flatnonzero(text == 0)
        lengths = np.diff(ends, prepend=-1)
        to_end = np.repeat(ends, lengths) - np.arange(n)
        order = suffix_order(text, to_end)
        last = text[order - 1] if n else text
        sigma = int(text.max(initial=0)) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.levels, self.zeros = [], []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (last >> level) & 1 == 1
            self.levels.append((level, np.concatenate([[0], np.cumsum(~bit, dtype=np.int32)]).astype(np.int32)))
            self.zeros.append(int(n - bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))
        from_start = np.repeat(lengths, lengths) - 1 - to_end
        marked = from_start[order] % step == 0
        self.marked = marked
        self.samples_before = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def _descend(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for (level, rank0), zeros in zip(self.levels, self.zeros):
            left = rank0[rows]
            rows = np.where((symbols >> level) & 1 == 1, zeros + rows - left, left)
        return rows

    def _step_back(self, rows: np.ndarray) -> np.ndarray:
        """Row of the suffix that starts one word earlier."""
        symbols, at = np.zeros(len(rows), np.int64), rows
        for (level, rank0), zeros in zip(self.levels, self.zeros):
            left = rank0[at]
            bit = rank0[at + 1] == left
            symbols |= bit.astype(np.int64) << level
            at = np.where(bit, zeros + at - left, left)
        return self.below[symbols] + at - self.first[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of ids, left-aligned) that occur, with the first and last+1 row of their suffixes."""
        who = np.arange(len(phrases))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for k in range(int(lengths.max(initial=0))):
            going = lengths[who] > k
            symbols = np.where(going, phrases[who, np.maximum(lengths[who] - 1 - k, 0)], 0)
            known = symbols < len(self.below)
            symbols = np.where(known, symbols, 0)
            offset = self.below[symbols] - self.first[symbols]
            new_low = offset + self._descend(symbols, low)
            new_high = offset + self._descend(symbols, high)
            low, high = np.where(going, new_low, low), np.where(going, new_high, high)
            alive = (low < high) & known
            who, low, high = who[alive], low[alive], high[alive]
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by walking back to a sampled one."""
        out, walked = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows
        while len(left):
            found = self.marked[at]
            out[left[found]] = self.samples[self.samples_before[at[found]]] + walked
            left, at = left[~found], self._step_back(at[~found])
            walked += 1
        return out


def suffix_order(text: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Positions sorted by the words up to the run's end, then by position.

    The first key packs as many words as fit into 62 bits; groups that still tie are refined with the rank of what
    follows, which at least doubles the depth each time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(text.max()).bit_length())
    depth = 62 // bits
    padded = np.concatenate([text, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = (key << bits) | np.where(to_end > k, padded[k : k + n], 0)
    positions, rows, rank = np.argsort(key, kind="stable"), np.arange(n), np.empty(n, np.int64)
    key = key[positions]
    while len(positions):
        fresh = np.ones(len(positions), bool)  # else equal to the one before, as far as `depth` words show
        fresh[1:] = (key[1:] != key[:-1]) | (to_end[positions[1:]] < depth)
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(positions)), 0))
        rank[positions] = rows[head]
        tied = np.bincount(head, minlength=len(positions))[head] > 1
        positions, rows = positions[tied], rows[tied]
        key = rank[positions] * np.int64(n + 1) + rank[positions + depth]
        by = np.argsort(key, kind="stable")
        positions, key = positions[by], key[by]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out
