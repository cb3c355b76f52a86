"""Recompression of token sequences: rounds that name runs and pairs alike wherever they occur.

A round either names every maximal run of one symbol or every pair whose first symbol falls on the left and whose second
on the right side of a split of all symbols. Names are hashes of what they stand for and a symbol's side is a
hash of its name and the round, so all tasks agree on them without exchanging a dictionary. A collision can only make two
different symbols look shared; it never parts equal ones.

Each symbol carries the span of tokens that its name and place follow from. Where two places hold the same tokens, they
hold the same symbols wherever that span lies inside.
"""

from __future__ import annotations

import numpy as np

from tidewell.llm.common import mix64

#: Rounds in their order: "r" names runs, "p" names pairs.
ROUNDS = "rppppp"

_U = np.uint64


class Symbols:
    """name, token range [start, end) and span [low, high] of each symbol; bars (document ends) never join."""

    def __init__(self, name, start, end, low, high, bar):
        self.name, self.start, self.end, self.low, self.high, self.bar = name, start, end, low, high, bar


def tokens_with_bars(hashes: np.ndarray, doc_ends: np.ndarray) -> Symbols:
    """Level 0 of documents laid end to end, with a bar before, between and after them.

    A token's place counts the bars before it: token i of document k lies at i + k + 1.
    """
    n_docs = len(doc_ends)
    n = len(hashes) + n_docs + 1
    bar = np.zeros(n, bool)
    bar[0] = True
    bar[doc_ends + np.arange(n_docs) + 1] = True
    name = np.zeros(n, np.uint64)
    name[~bar] = hashes
    place = np.arange(n, dtype=np.int64)
    return Symbols(name, place, place + 1, place, place, bar)


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The span's low end of the symbol before and its high end of the one after; itself at the edges."""
    before, after = np.empty_like(s.low), np.empty_like(s.high)
    before[0], before[1:] = s.low[0], s.low[:-1]
    after[-1], after[:-1] = s.high[-1], s.high[1:]
    return before, after


def name_pairs(s: Symbols, salt: int) -> Symbols:
    right = mix64(s.name + _U(salt)) & _U(1) == 1
    left = ~right & ~s.bar
    right &= ~s.bar
    first = np.zeros(len(left), bool)
    first[:-1] = left[:-1] & right[1:]
    second = np.zeros(len(left), bool)
    second[1:] = first[:-1]
    before, after = _neighbours(s)
    # a left symbol looks at the one after it, a right symbol at the one before
    high = np.where(left, np.maximum(s.high, after), s.high)
    low = np.where(right, np.minimum(s.low, before), s.low)
    name, end = s.name.copy(), s.end.copy()
    at = np.flatnonzero(first)
    name[at] = mix64(s.name[at] * _U(0x9E3779B97F4A7C15) + mix64(s.name[at + 1] + _U(1)))
    end[at] = s.end[at + 1]
    low[at], high[at] = s.low[at], s.high[at + 1]
    keep = ~second
    return Symbols(name[keep], s.start[keep], end[keep], low[keep], high[keep], s.bar[keep])


def name_runs(s: Symbols) -> Symbols:
    begins = np.ones(len(s.name), bool)
    begins[1:] = (s.name[1:] != s.name[:-1]) | s.bar[1:] | s.bar[:-1]
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(begins)))
    before, after = _neighbours(s)
    last = at + size - 1
    # that a run ends follows from the symbols around it
    low, high = np.minimum(s.low[at], before[at]), np.maximum(s.high[last], after[last])
    name = np.where(size > 1, mix64(s.name[at] ^ mix64(size.astype(np.uint64) + _U(7 << 32))), s.name[at])
    return Symbols(name, s.start[at], s.end[last], low, high, s.bar[at])


def recompress(hashes: np.ndarray, doc_ends: np.ndarray, rounds: str = ROUNDS) -> Symbols:
    s = tokens_with_bars(hashes, doc_ends)
    for k, kind in enumerate(rounds):
        s = name_runs(s) if kind == "r" else name_pairs(s, 0x5851F42D * (k + 1))
    return s


def anchors(s: Symbols, places: np.ndarray, window: int) -> np.ndarray:
    """For windows that start at ``places`` (ascending), the index of their anchor in s, or -1 if they hold no whole symbol.

    A window's anchor is the symbol of the least hashed name among those whose span lies inside it (the leftmost of equal
    ones), so equal windows have equal anchors at equal distances.
    """
    own = np.flatnonzero(~s.bar)
    if not len(own) or not len(places):
        return np.full(len(places), -1, np.int64)
    low, high, rank = np.maximum.accumulate(s.low[own]), s.high[own], mix64(s.name[own] ^ _U(0x6A09E667F3BCC909))
    high = np.minimum.accumulate(high[::-1])[::-1] if (np.diff(high) < 0).any() else high
    a = np.searchsorted(low, places, "left")
    b = np.searchsorted(high, places + window, "left")
    size = b - a
    out = np.full(len(places), -1, np.int64)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    # windows with the same first and last whole symbol share their anchor
    change = np.ones(len(some), bool)
    change[1:] = (np.diff(a[some]) != 0) | (np.diff(b[some]) != 0)
    ranges = some[change]
    lo, n = a[ranges], size[ranges]
    best = np.empty(len(ranges), np.int64)
    table, step = np.arange(len(rank)), 1  # the least of each ``step`` symbols
    while True:
        mine = np.flatnonzero((n >= step) & (n < 2 * step))
        if len(mine):
            x, y = table[lo[mine]], table[lo[mine] + n[mine] - step]
            best[mine] = np.where(rank[y] < rank[x], y, x)
        if not (n >= 2 * step).any():
            break
        x, y = table[: len(table) - step], table[step:]
        table, step = np.where(rank[y] < rank[x], y, x), 2 * step
    out[some] = own[best][np.cumsum(change) - 1]
    return out
