"""Byte-pair merges of many words at once, in flat numpy arrays.

All symbols of all words lie in one array. A round takes the least pair rank of every word (a
segmented minimum) and merges that pair wherever the word has it, leftmost first, places that
overlap left out; then the arrays are compacted. Merging one at a time, leftmost first, would come
to the same unless a merge makes a new pair of that rank or a lower one, which has to go before the
rest: the places behind such a merge wait for the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = np.int32(2**31 - 1)


def grouped(words: list[str], most: int) -> Iterator[list[str]]:
    """Runs of words of about `most` characters, one word at least."""
    group, size = [], 0
    for w in words:
        group.append(w)
        size += len(w)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


class MergeTable:
    """Ranks and results of pairs of symbols, from {left << 24 | right: (rank, merged symbol)}."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, and their places in the table."""
        key = left.astype(np.int64) << 24 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains. word: the number of each symbol's word, rising."""
        word = word.astype(np.int32)
        rank = np.full(len(symbols), NONE, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.look_up(symbols[inside], symbols[inside + 1])[0]
        done_symbols, done_words = [symbols[:0]], [word[:0]]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            idle = least == NONE
            if idle.any():  # finished words leave the array
                out = np.repeat(idle, sizes)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                symbols, word, rank, least, sizes = symbols[~out], word[~out], rank[~out], least[~idle], sizes[~idle]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])  # of neighbours every other one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            made = self.merged[self.look_up(symbols[at], symbols[at + 1])[1]]
            waits = self.waiting(symbols, word, rank, at, made)
            if waits is not None:
                at, made = at[~waits], made[~waits]
            symbols[at] = made
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # each removal lies behind its own place and before the next
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            rank[at] = NONE
            right = at[at + 1 < len(symbols)]
            right = right[word[right] == word[right + 1]]
            rank[right] = self.look_up(symbols[right], symbols[right + 1])[0]
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self.look_up(symbols[left], symbols[left + 1])[0]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def waiting(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray, made: np.ndarray) -> np.ndarray | None:
        """True for the places behind an earlier one of their word whose merge makes a pair that goes first."""
        same = word[at[1:]] == word[at[:-1]]
        if not same.any():
            return None
        several = np.flatnonzero(np.r_[same, False])  # places that others of the word follow
        place, new, own = at[several], made[several], rank[at[several]]
        after = np.minimum(place + 2, len(symbols) - 1)
        urgent = (place + 2 < len(symbols)) & (word[after] == word[place]) & (self.look_up(new, symbols[after])[0] <= own)
        before = np.maximum(place - 1, 0)
        merged = (several > 0) & (at[np.maximum(several - 1, 0)] == place - 2)  # the neighbour was made just before
        beside = np.where(merged, made[np.maximum(several - 1, 0)], symbols[before])
        urgent |= (place > 0) & (word[before] == word[place]) & (self.look_up(beside, new)[0] <= own)
        if not urgent.any():
            return None
        urgents = np.zeros(len(at), np.int64)
        urgents[several] = urgent
        total = np.cumsum(urgents) - urgents
        first = np.flatnonzero(np.r_[True, ~same])
        return total > np.repeat(total[first], np.diff(np.r_[first, len(at)]))
