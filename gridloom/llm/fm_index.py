"""A compressed full-text index: the Burrows-Wheeler transform in a wavelet matrix of packed bits, searched backwards."""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Counts the occurrences of patterns of at most `order` symbols in a text of small positive integers.

    Zeros separate what no pattern may span. Suffixes are sorted by doubling, only as far as patterns reach; beyond that
    their order doesn't matter to a pattern's interval.
    """

    def __init__(self, text: np.ndarray, order: int):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        rank, k = text, 1
        while k <= order:
            after = np.concatenate([rank[k:], np.zeros(min(k, n), dtype=np.int64)])[:n]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            k *= 2
        suffixes = np.argsort(rank, kind="stable")
        bwt = text[suffixes - 1]
        self.size = n
        self.bits = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.bits) + 1)
        self.below = np.cumsum(counts) - counts
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, dtype=np.int64)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            full = np.cumsum(np.bitwise_count(packed).astype(np.int64))
            self.ones.append(np.concatenate([[0], full[:-1]]))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        every = np.arange(1 << self.bits, dtype=np.int64)
        self.start = self._descend(every, np.zeros(len(every), dtype=np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            word, offset = place >> 6, (place & 63).astype(np.uint64)
            inside = self.words[k][word] & ((np.uint64(1) << offset) - np.uint64(1))
            ones = self.ones[k][word] + np.bitwise_count(inside)
            place = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from the intervals of the patterns."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.below[symbol] - self.start[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def repeated(self, text: np.ndarray, first: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which windows of size symbols occur at least twice: (piece, window) of each.

        Piece p has windows[p] windows, the k-th starting at text[first[p] + k]. A search runs backwards from a window's
        end. Where the match stops occurring twice at some place, no window that reaches back to there can occur twice,
        so the piece goes on with the first window that starts after it: the matching statistics' skip.
        """
        live = np.arange(len(first))
        window = np.zeros(len(first), dtype=np.int64)
        place = first + size
        low, high = np.zeros(len(first), dtype=np.int64), np.full(len(first), self.size, dtype=np.int64)
        found_piece, found_window = [], []
        while len(live):
            at = place[live] - 1
            a, z = self.extend(text[at], low[live], high[live])
            low[live], high[live], place[live] = a, z, at
            start = first[live] + window[live]
            fails, ends = z - a < 2, (z - a >= 2) & (at == start)
            found_piece.append(live[ends])
            found_window.append(window[live[ends]])
            moved = live[fails | ends]
            window[moved] = np.where((high - low)[moved] < 2, place[moved] - first[moved] + 1, window[moved] + 1)
            place[moved] = first[moved] + window[moved] + size
            low[moved], high[moved] = 0, self.size
            live = live[window[live] < windows[live]]
        return np.concatenate(found_piece or [live]), np.concatenate(found_window or [live])
