"""FM-index over one training shard: suffix order, wavelet ranks, backward search and sampled positions, in numpy.

The text is an array of symbols from 1; 0 separates stretches. Each separator counts as a symbol of its own (ordered by
place), so suffixes are distinct and no match runs over one.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text a suffix position is kept; a stretch's first position always is.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order: ranks by doubled prefixes, sorting only what is still tied."""
    n = len(text)
    cut = text == 0
    n_cuts = int(cut.sum())
    key = text.astype(np.int64) + n_cuts - 1
    key[cut] = np.arange(n_cuts)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    reach = 1
    while True:
        first = rank[order]
        last_of_group = np.concatenate([first[1:] != first[:-1], [True]])
        tied = np.flatnonzero(~(last_of_group & (first == np.arange(n))))
        if not len(tied):
            return order
        mine, lead = order[tied], first[tied]
        follow = rank[np.minimum(mine + reach, n)]
        by = np.lexsort((follow, lead))
        mine, lead, follow = mine[by], lead[by], follow[by]
        order[tied] = mine
        opens = np.concatenate([[True], (lead[1:] != lead[:-1]) | (follow[1:] != follow[:-1])])
        rank[mine] = np.maximum.accumulate(np.where(opens, tied, 0))
        reach *= 2


class WaveletMatrix:
    """access and rank over an array of symbols, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n_bits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        row = symbols.astype(np.uint32)
        for level in reversed(range(self.n_bits)):
            bit = (row >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before place ``at``."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.n_bits):
            one = (symbol >> (self.n_bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, end)
            start = np.where(one, self.zeros[level] + a, start - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        at, symbol = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in range(self.n_bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """``text`` has symbols under ``n_symbols`` and starts with a separator."""
        order = suffix_order(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        opens = np.concatenate([[True], text[:-1] == 0])
        kept = (order % SAMPLE == 0) | opens[order] | (text[order] == 0)
        self.kept = WaveletMatrix(kept, 2)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that start with each phrase (rows of one length); none if they are equal."""
        n = len(phrases)
        first, end, alive = np.zeros(n, np.int64), np.full(n, self.n, np.int64), np.arange(n)
        for step in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, step]
            base = self.less[symbol]
            first[alive] = base + self.wavelet.rank(symbol, first[alive])
            end[alive] = base + self.wavelet.rank(symbol, end[alive])
            alive = alive[first[alive] < end[alive]]
        dead = np.ones(n, bool)
        dead[alive] = False
        end[dead] = first[dead]
        return first, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text until a kept position."""
        found, at, steps, open_ = np.empty(len(rows), np.int64), rows.astype(np.int64), 0, np.arange(len(rows))
        one = np.ones(1, np.int64)
        while len(open_):
            kept = self.kept.access(at).astype(bool)
            place = self.kept.rank(np.broadcast_to(one, int(kept.sum())), at[kept])
            found[open_[kept]] = self.positions[place] + steps
            at, open_ = at[~kept], open_[~kept]
            symbol = self.wavelet.access(at)
            at = self.less[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return found
