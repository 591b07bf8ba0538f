"""An adaptive abstention threshold whose state is bounded: the fold, and the ordered values that it has seen."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np

CAPACITY = 4096


class OrderedValues:
    """Values seen, by rank, in bounded room.

    The first ``capacity - 1`` values are held as they are, so ranks are exact. A buffer that
    fills is halved: of its sorted values every second one goes to the buffer above, where a
    value stands for twice as many; even and odd ones in turn. A halving moves no rank by
    more than the weight of one value, so after n values a rank is wrong by at most
    n * log2(n / capacity) / capacity, and there are at most 1 + log2(n / capacity) buffers.
    """

    def __init__(self, capacity: int = CAPACITY, levels: dict[int, np.ndarray] | None = None, turns: int = 0):
        if capacity < 2 or capacity % 2:
            raise ValueError("capacity must be even")
        self.capacity, self.turns = capacity, turns
        self.levels = {k: sorted(v.tolist()) for k, v in (levels or {}).items()} or {0: []}
        self.levels.setdefault(0, [])
        self.changed: set[int] = set()
        self._gather()

    def _gather(self) -> None:
        """The values above the lowest buffer, in order, with the weight before each."""
        upper = sorted((x, 1 << k) for k, v in self.levels.items() if k for x in v)
        self._values = [x for x, _ in upper]
        self._before = np.concatenate(([0], np.cumsum([w for _, w in upper], dtype=np.int64))).tolist()
        self.n = self._before[-1] + len(self.levels[0])

    def add(self, x: float) -> None:
        insort(self.levels[0], x)
        self.changed.add(0)
        self.n += 1
        level = 0
        while len(self.levels[level]) >= self.capacity:
            kept = self.levels[level][(self.turns >> level) & 1 :: 2]
            self.turns ^= 1 << level
            self.levels[level] = []
            self.levels[level + 1] = sorted(self.levels.get(level + 1, []) + kept)
            self.changed |= {level, level + 1}
            level += 1
        if level:
            self._gather()

    def at(self, rank: int) -> float:
        """The value at a rank, from 0."""
        low, upper = self.levels[0], self._values
        # how many of the upper values stand wholly at or before the rank
        a, b = 0, len(upper)
        while a < b:
            mid = (a + b) // 2
            if self._before[mid + 1] + bisect_left(low, upper[mid]) <= rank:
                a = mid + 1
            else:
                b = mid
        if a == len(upper):
            return low[rank - self._before[a]]
        # the next upper value covers the rank, unless a lower one before it does
        i = rank - self._before[a]
        return low[i] if i < bisect_left(low, upper[a]) else upper[a]

    def quantile(self, q: float) -> float:
        """Interpolated between neighbouring ranks."""
        place = q * (self.n - 1)
        first = int(place)
        a, b = self.at(first), self.at(min(first + 1, self.n - 1))
        t = place - first
        return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


class AdaptiveThreshold:
    """Level, and the finite uncertainties seen.

    Until ``warmup`` values are seen everything is answered. An abstained item counts as
    no error; the level moves by gamma times target less error, within [1e-4, 0.999]. The
    threshold is the quantile of what was seen at one less the level.
    """

    def __init__(self, alpha: float = 0.1, gamma: float = 0.05, warmup: int = 8, level: float | None = None, seen: OrderedValues | None = None):
        self.alpha, self.gamma, self.warmup = alpha, gamma, warmup
        self.level, self.seen = alpha if level is None else level, seen or OrderedValues()

    def step(self, u: float, ok: bool) -> tuple[float, bool, bool, float]:
        """tau, retained, error and the level that applied."""
        tau = math.inf if self.seen.n < self.warmup else self.seen.quantile(min(max(1 - self.level, 0), 1))
        keep, used = u <= tau, self.level
        error = keep and not ok
        self.level = min(max(self.level + self.gamma * (self.alpha - float(error)), 1e-4), 0.999)
        if math.isfinite(u):
            self.seen.add(float(u))
        return tau, bool(keep), bool(error), used
