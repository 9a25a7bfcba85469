"""An FM-index over sequences of small integers: suffix order, wavelet matrix of the last column, sampled positions."""

from __future__ import annotations

import numpy as np

STRIDE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. Symbol 0 is a separator: each one is smaller than those behind it and than every other
    symbol, so no comparison goes past one, and prefix doubling ends with the longest stretch between two."""
    n = len(symbols)
    gaps = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ordered = rank[order]
        new = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        # Only suffixes that still tie are sorted again, within their places.
        tied = np.zeros(n, bool)
        tied[1:] = new[1:] == new[:-1]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        mine = order[places]
        by = np.lexsort((behind[mine], new[places]))
        order[places] = mine[by]
        key = new * (n + 1)
        key[places] += behind[order[places]]
        rank = np.empty(n, np.int64)
        rank[order] = key
        width *= 2


class WaveletMatrix:
    """Rank over a sequence, one bit of the symbol a level, the highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones, self.zeros = [], []
        rest = symbols
        for level in range(bits - 1, -1, -1):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.last = rest
        values, starts = np.unique(rest, return_index=True) if len(rest) else (rest, rest)
        self.first = np.zeros((1 << bits) + 1, np.int64)
        self.first[values] = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each `symbol` occurs before position `at`."""
        at = at.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at - self.first[symbol]


class FMIndex:
    """Backward search and location of patterns without symbol 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]  # the text is closed by a separator, so the one before position 0 is never used
        self.tree = WaveletMatrix(last, max(1, int(n_symbols).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.last = last
        # Every STRIDE-th position is kept, and each one behind a separator, so that no walk has to cross one.
        kept = (order % STRIDE == 0) | (last == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept = kept
        self.sample = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the patterns, given as rows padded at their end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, given by their place in the order."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.last[at]
            rows[walking] = self.below[symbol] + self.tree.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.sample[self.kept_before[rows]] + steps
