"""The BPE agenda over many words at once, in arrays.

Symbols of all words lie one after the other, with a place that merges with nothing before each word and at
the end. Neighbours are linked lists over places. A candidate's key is its rank in the upper and its place in
the lower half of one number, so that the least key of a word is its next turn: the best pair, the leftmost of
equals. Every turn takes one candidate of each word that still has one. Memory is that of the arrays; nothing is
kept from one call to the next.
"""

from collections.abc import Callable

import numpy as np

FREE = np.int64(1 << 62)  # the key of a place without a candidate
_PLACE = np.int64((1 << 32) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """What two neighbouring symbols merge into: an open-addressed table with numpy look-ups."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        """pairs: (left, right) to (rank, merged symbol)."""
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key, self.rank, self.merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, FREE, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        rank, merged = np.array(list(pairs.values()), np.int64).reshape(-1, 2).T
        slot, todo = self.slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            placed = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[placed]
            self.key[at], self.rank[at], self.merged[at] = keys[placed], rank[placed] << 32, merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank, shifted into a key's upper half, and the merged symbol; FREE where the two do not merge."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self.slots(keys)
        there = self.key[slot]
        lost = np.flatnonzero((there != keys) & (there >= 0))
        while len(lost):
            slot[lost] = at = (slot[lost] + 1) & self.mask
            there[lost] = now = self.key[at]
            lost = lost[(now != keys[lost]) & (now >= 0)]
        return np.where(there == keys, self.rank[slot], FREE), self.merged[slot]


def merge_by_turns(pairs: PairTable, symbol: np.ndarray, first: np.ndarray, sizes: np.ndarray, skip: Callable[[np.ndarray, int], np.ndarray] | None = None) -> np.ndarray:
    """Merges in place and returns which places still hold a symbol (those between the words included).

    first and sizes: where each word begins and how many places it has, none of them empty. skip(words, turn) tells
    for which of these words the candidate of this turn is passed over; it comes back when one of its parts changes.
    """
    after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
    key, both = np.full(len(symbol), FREE), np.zeros(len(symbol), np.int32)
    rank, both[:-1] = pairs.find(symbol[:-1], symbol[1:])
    key[:-1] = rank | np.arange(len(symbol) - 1)
    open_, at, where, turn = np.arange(len(first)), first, None, 0
    alive = np.ones(len(symbol), bool)
    while len(open_):
        least = np.minimum.reduceat(key if where is None else key[where], at)
        on = np.flatnonzero(least < FREE)
        if not len(on):
            break
        left = least[on] & _PLACE
        if skip is not None:
            passed = skip(open_[on], turn)
            key[left[passed]] = FREE
            left = left[~passed]
        right = after[left]
        symbol[left], alive[right], key[right] = both[left], False, FREE
        after[left] = follows = after[right]
        before[follows] = left
        comes = before[left]
        rank, both[left] = pairs.find(symbol[left], symbol[follows])
        key[left] = rank | left
        rank, both[comes] = pairs.find(symbol[comes], symbol[left])
        key[comes] = rank | comes
        turn += 1
        if where is None or len(on) < 0.7 * len(open_):
            open_ = open_[on]
            size = sizes[open_]
            at = np.cumsum(size) - size
            where = np.arange(int(size.sum())) + np.repeat(first[open_] - at, size)
    return alive
