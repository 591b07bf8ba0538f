"""Ids of many short byte strings: each distinct one of a chunk is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from counterlens.llm import kernel as K


class UnitCache:
    """Remembers what ``encode`` made of byte strings, at most ``limit`` of them.

    ``encode`` maps a list of byte strings to a list of little-endian 16- or 32-bit id
    strings. Equal units of a chunk are found by two 64-bit hashes; the memory itself is
    keyed by the bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], dtype: str, limit: int = 400_000):
        self.encode, self.dtype, self.limit = encode, np.dtype(dtype), limit
        self.known: dict[bytes, bytes] = {}

    def _ids(self, units: list[bytes]) -> list[bytes]:
        known = self.known
        got = list(map(known.get, units))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            made = self.encode([units[i] for i in new])
            if len(known) + len(new) > self.limit:
                known.clear()
            for i, x in zip(new, made):
                got[i] = known[units[i]] = x
        return got

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in unit order, and how many each unit has."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        h, g = (K.hash_segments(buf, starts, ends, seed) for seed in (1, 2))
        order = np.argsort(h)
        hs = h[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        group_sorted = np.cumsum(new) - 1
        rep = order[new]
        if not np.array_equal(g[order], g[rep][group_sorted]):  # two strings with one hash
            rep, group = np.arange(len(starts)), np.arange(len(starts))
        else:
            group = np.empty(len(starts), np.int64)
            group[order] = group_sorted
        view = memoryview(np.ascontiguousarray(buf))
        parts = self._ids([view[a:b].tobytes() for a, b in zip(starts[rep].tolist(), ends[rep].tolist())])
        size = self.dtype.itemsize
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        flat = np.frombuffer(b"".join(parts), self.dtype)
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        per = lengths[group]
        out_at = np.cumsum(per) - per
        src = np.arange(int(per.sum())) + np.repeat(at[group] - out_at, per)
        return flat[src], per
