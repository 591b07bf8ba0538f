"""Words of UTF-8 text in numpy, a chunk of documents at a time.

All functions work on the bytes that Arrow already holds, so no Python string is
made per word. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as
these are ASCII, this is the same as a run of such characters.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20

#: What a worker process holds between tasks for one operator, as functions that let it go.
LETS_GO: dict[str, Callable[[], None]] = {}
_owner = [""]


def enter(owner: str) -> None:
    """A task of this owner begins here: what other owners hold in this process is let go."""
    if _owner[0] != owner:
        for name, let_go in LETS_GO.items():
            if name != owner:
                let_go()
        _owner[0] = owner
        gc.collect()
        pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """The first n values of a fixed pseudo-random sequence."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_VALUES = {seed: stream(seed, 256) for seed in (1, 2)}
_PLACES = {seed: stream(seed + 100, 1 << 12) | U64(1) for seed in (1, 2)}


def _places(seed: int, n: int) -> np.ndarray:
    if n > len(_PLACES[seed]):
        _PLACES[seed] = stream(seed + 100, 2 * n) | U64(1)
    return _PLACES[seed]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of text; a longer text stands alone."""
    enter(owner)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += n
        yield batch.slice(begin)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each document's first word (with a final total)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for sorted, disjoint, non-empty segments."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lengths = ends - starts
    lo, hi = int(starts[0]), int(ends[-1])
    part = buf[lo:hi]
    reach = np.diff(np.append(starts, hi))
    place = np.arange(hi - lo, dtype=np.int32)
    place -= np.repeat((starts - lo).astype(np.int32), reach)
    gaps = reach != lengths
    value = _BYTE_VALUES[seed][part]
    value *= _places(seed, int(reach.max()))[place]
    if gaps.any():  # bytes between segments count as nothing
        value[place >= np.repeat(lengths.astype(np.int32), reach)] = 0
    sums = np.add.reduceat(value, starts - lo)
    return mix(sums + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of one document, and each run's first word."""
    if len(hashes) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(hashes) - width + 1
    factors = stream(seed, width) | U64(1)
    out = np.zeros(n, U64)
    for j in range(width):
        out += hashes[j : j + n] * factors[j]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mix(out[at]), at


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted non-negative integers, after a byte that says how: 0, as 16-bit gaps, of which 65535 means 'add 65535 and read on'; 4 or 8, as they are."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    more, rest = np.divmod(gaps, 65535)
    width = 4 if not len(values) or int(values[-1]) < 1 << 32 else 8
    if 2 * (int(more.sum()) + len(values)) > width * len(values):
        return bytes([width]) + values.astype(f"<u{width}").tobytes()
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 65535, np.uint16)
    out[ends] = rest
    return b"\0" + out.astype("<u2").tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)
    gaps = np.frombuffer(data, "<u2", offset=1)
    return np.cumsum(gaps.astype(np.int64))[gaps != 65535]
