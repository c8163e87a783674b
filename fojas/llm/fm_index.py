"""An FM-index over a sequence of word symbols: suffix array, BWT in a wavelet matrix, sampled positions.

Symbols are 1 and up; 0 ends a run. Runs end in separators that are told apart by their order, so no
comparison of suffixes, no match and no walk back crosses a run.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling; every run of ``symbols`` must end in 0."""
    n = len(symbols)
    separators = symbols == 0
    n_sep = int(separators.sum())
    rank = np.where(separators, np.cumsum(separators) - 1, symbols.astype(np.int64) + n_sep - 1)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        keys = rank * (int(max(rank.max(initial=0), after.max(initial=0))) + 1) + after
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) if n else rank
        if not n or new[order[-1]] == n - 1:
            return order
        rank = new
        width *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 8):
        n = len(symbols)
        order = suffix_array(symbols)
        self.bwt_wavelet(symbols[order - 1])
        counts = np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        begins = np.concatenate(([True], symbols[:-1] == 0))
        self.sampled = (order % sample == 0) | begins[order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.sample_place = order[self.sampled]
        self.n = n

    def bwt_wavelet(self, bwt: np.ndarray) -> None:
        """Levels from the highest bit down: how many ones come before each place, and the number of zeros."""
        self.bits = max(1, int(bwt.max(initial=0)).bit_length())
        self.levels = []
        for b in reversed(range(self.bits)):
            bit = (bwt >> b) & 1
            ones = np.zeros(len(bwt) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(bwt) - int(ones[-1])))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the BWT before each place."""
        at, zero = places.copy(), np.zeros_like(places)
        for b, ones, zeros in self.levels:
            bit = ((symbols >> b) & 1).astype(bool)
            for x in (at, zero):
                r = ones[x]
                x[:] = np.where(bit, zeros + r, x - r)
        return at - zero

    def access(self, places: np.ndarray) -> np.ndarray:
        at, out = places.copy(), np.zeros(len(places), np.int64)
        for b, ones, zeros in self.levels:
            r = ones[at]
            bit = (ones[at + 1] - r).astype(bool)
            out |= bit.astype(np.int64) << b
            at = np.where(bit, zeros + r, at - r)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``phrases`` (equal lengths) that occur, and their ranges of suffixes, by backward search."""
        alive = np.flatnonzero((phrases < len(self.before) - 2).all(axis=1))  # symbols that the text has
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            left = lo < hi
            alive, lo, hi = alive[left], lo[left], hi[left]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, walked back to the nearest sampled one."""
        out, at, which, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(at):
            done = self.sampled[at]
            out[which[done]] = self.sample_place[self.sample_rank[at[done]]] + steps
            at, which = at[~done], which[~done]
            c = self.access(at)
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out
