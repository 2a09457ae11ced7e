"""An FM-index over words: suffix order, wavelet-tree ranks, backward search, sampled positions.

The text is a sequence of symbols 1..n_symbols in stretches that end with 0. Many patterns are
searched at once; every step works on whole arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; each 0 counts as a symbol of its own, so comparison ends at a stretch's end.

    Prefix doubling that sorts, in each round, only what is still tied."""
    n = len(text)
    ends = text == 0
    symbol = np.where(ends, np.cumsum(ends), text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(symbol, kind="stable")
    ordered = symbol[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        group = rank[order]
        tied = np.concatenate([group[1:] == group[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        some = order[at]
        old, behind = rank[some], rank[some + step]
        by = np.lexsort((behind, old))
        some, old, behind = some[by], old[by], behind[by]
        order[at] = some
        opens = np.concatenate([[True], old[1:] != old[:-1]])
        differs = opens | np.concatenate([[True], behind[1:] != behind[:-1]])
        place = np.arange(len(some))
        rank[some] = old + np.maximum.accumulate(np.where(differs, place, 0)) - np.maximum.accumulate(np.where(opens, place, 0))
        step *= 2


class FMIndex:
    """Index of one shard; ``sample`` is the distance between stored positions."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8) -> None:
        order = suffix_order(text)
        self.last = text[order - 1]  # the Burrows-Wheeler transform
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # of each symbol, suffixes with a smaller first one
        # positions at which a stretch begins are stored as well: no walk crosses a border
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.last
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            rank = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            zeros = len(row) - int(rank[-1])
            self.levels.append((bit, rank, zeros))
            row = np.concatenate([row[ones == 0], row[ones == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``end`` of the transform."""
        begin = np.zeros_like(end)
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - begin

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern: patterns[i, :length[i]], symbols 1.. only."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.last), np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            live = np.flatnonzero((length >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, length[live] - back]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by walking back to a stored one."""
        found, walked = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            there = self.kept[at]
            found[todo[there]] = self.positions[self.kept_rank[at[there]]] + walked[todo[there]]
            todo, at = todo[~there], at[~there]
            symbol = self.last[at]
            at = self.before[symbol] + self.rank(symbol, at)
            walked[todo] += 1
        return found
