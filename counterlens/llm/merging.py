"""Byte-pair merging of many short strings at once, in numpy.

A string is a row of symbols. In every round each row merges its leftmost pair of lowest
rank, until no row has a pair left: the result is that of merging row by row. Rows of
about equal length share a matrix.
"""

from __future__ import annotations

import numpy as np

from counterlens.llm import kernel as K

NONE = np.int32(2**31 - 1)
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
LONGEST = WIDTHS[-1]


class IntTable:
    """Values of non-negative 64-bit keys, in open addressing; absent keys have ``missing``."""

    def __init__(self, missing: int, bits: int = 10):
        self.missing = missing
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.missing, np.int32)

    def clear(self) -> None:
        self._empty(10)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * K.U64(0x9E3779B97F4A7C15)) >> K.U64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Store distinct keys that the table does not have."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self._empty(max(10, (3 * len(keys)).bit_length()))
        self.count += len(keys)
        slot, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self._slots(keys), len(self.keys) - 1
        met = self.keys[slot]
        out = self.values[slot]
        far = np.flatnonzero((met != keys) & (met >= 0))
        out[met < 0] = self.missing
        while len(far):
            slot[far] = (slot[far] + 1) & mask
            met = self.keys[slot[far]]
            out[far] = np.where(met < 0, self.missing, self.values[slot[far]])
            far = far[(met != keys[far]) & (met >= 0)]
        return out


class PairMerges:
    """Merging by rank: ``left`` and ``right`` give ``made[rank]``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.ranks, self.made = IntTable(int(NONE)), made.astype(np.int32)
        self.ranks.add(left.astype(np.int64) << 20 | right, rank.astype(np.int32))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks.get(left.astype(np.int64) << 20 | right)

    def _matrix(self, sym: np.ndarray, lengths: np.ndarray) -> None:
        """Merge the rows of ``sym``; a symbol that went into the one before it becomes -1."""
        n, width = sym.shape
        rank = np.full((n, width), NONE, np.int32)
        row, col = np.nonzero(np.arange(1, width) < lengths[:, None])
        rank[row, col] = self._rank(sym[row, col], sym[row, col + 1])
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))  # of column ``width``: the end
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        rows = np.arange(n)
        while len(rows):
            open_ = rank[rows]
            p = open_.argmin(1)
            best = open_[np.arange(len(rows)), p]
            live = best != NONE
            rows, p, best = rows[live], p[live], best[live]
            q = after[rows, p]
            r = after[rows, q]
            sym[rows, p], sym[rows, q] = self.made[best], -1
            rank[rows, q] = NONE
            after[rows, p] = r
            before[rows, r] = p
            o = before[rows, p]
            left, right = np.flatnonzero(o >= 0), np.flatnonzero(r < lengths[rows])
            x = np.concatenate((sym[rows[left], o[left]], sym[rows[right], p[right]]))
            y = np.concatenate((sym[rows[left], p[left]], sym[rows[right], r[right]]))
            found = self._rank(x, y)
            rank[rows, p] = NONE
            rank[rows[left], o[left]] = found[: len(left)]
            rank[rows[right], p[right]] = found[len(left) :]

    def __call__(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each string of ``flat``, and how many each has; strings are of 1 to LONGEST symbols."""
        begin = np.cumsum(lengths) - lengths
        out, alive = flat.astype(np.int32), np.ones(len(flat), bool)
        kind = np.searchsorted(WIDTHS, lengths)
        for k in np.unique(kind).tolist():
            which = np.flatnonzero(kind == k)
            width = WIDTHS[k]
            for at in range(0, len(which), max(1, (4 << 20) // width)):
                some = which[at : at + max(1, (4 << 20) // width)]
                inside = np.arange(width) < lengths[some][:, None]
                place = (begin[some][:, None] + np.arange(width))[inside]
                sym = np.full((len(some), width), -1, np.int32)
                sym[inside] = out[place]
                self._matrix(sym, lengths[some])
                out[place] = sym[inside]
        alive = out >= 0
        upto = np.concatenate(([0], np.cumsum(alive)))
        return out[alive], upto[begin + lengths] - upto[begin]
