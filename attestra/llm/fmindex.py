"""An FM-index over words: suffix order to a bounded depth, a wavelet matrix of packed bits, backward search."""

from __future__ import annotations

import numpy as np

#: Patterns of up to so many words can be searched.
DEPTH = 128
#: A probe looks at so many words first; most windows without a second start fail there.
PROBE = 8


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` symbols, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if k >= depth or k >= n or new[-1] == n - 1:
            return order


class Bits:
    """Packed bits with counts before each 64."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, np.uint8)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Of texts that are runs of symbols >= 1; a 0 ends each."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        last = text[order - 1]
        size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels: list[tuple[int, Bits, int]] = []
        self.start = np.zeros(size, np.int64)  # where a symbol's run begins at the bottom
        symbols = np.arange(size)
        for shift in reversed(range(max(1, (size - 1).bit_length()))):
            bit = ((last >> shift) & 1).astype(np.uint8)
            level = Bits(bit)
            zeros = int(len(bit) - bit.sum())
            ones = level.rank(self.start)
            self.start = np.where((symbols >> shift) & 1, zeros + ones, self.start - ones)
            self.levels.append((shift, level, zeros))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.n = len(text)

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol followed by what the intervals stand for."""
        m = len(symbol)
        at = np.concatenate([low, high])
        twice = np.concatenate([symbol, symbol])
        for shift, level, zeros in self.levels:
            ones = level.rank(at)
            at = np.where((twice >> shift) & 1, zeros + ones, at - ones)
        at += np.concatenate([self.first[symbol] - self.start[symbol]] * 2)
        return at[:m], at[m:]

    def repeated(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
        """A mark on each place of text at which a window starts that the indexed texts hold more than once.

        text: symbols; begin, end: the documents streamed, read from right to
        left all at once. A probe of the first PROBE words of the rightmost window left
        comes first: if that is unique no window that holds it is repeated. Else
        the window is searched whole, and the match extended to the left as long as it
        occurs twice: every start on the way is marked.
        """
        marks = np.zeros(len(text), bool)
        probe = min(PROBE, window)
        s = end - window  # rightmost start left
        run = np.flatnonzero(s >= begin)
        begin, s = begin[run], s[run]
        full = np.zeros(len(run), bool)
        stop = s + probe
        at = stop.copy()  # the pattern is text[at:stop]
        low, high = np.zeros(len(run), np.int64), np.full(len(run), self.n, np.int64)
        while len(s):
            at -= 1
            low, high = self.back(text[at], low, high)
            twice = high - low >= 2
            hit = full & twice & (at <= s)
            marks[at[hit]] = True
            # a probe that holds: search the whole window
            grown = ~full & twice & (at == s)
            # a match that reaches the depth, or the document's begin
            spent = hit & ((stop - at >= DEPTH) | (at == begin))
            failed = ~twice
            s = np.where(failed & ~full, stop - window - 1, np.where(failed, np.where(at < s, at, s - 1), np.where(spent, at - 1, s)))
            anew = grown | failed | spent
            full = np.where(anew, grown, full)
            keep = s >= begin
            stop = np.where(anew, np.where(full, s + window, s + probe), stop)
            at = np.where(anew, stop, at)
            low, high = np.where(anew, 0, low), np.where(anew, self.n, high)
            if not keep.all():
                s, begin, full, stop, at, low, high = (x[keep] for x in (s, begin, full, stop, at, low, high))
        return marks
