"""Removal of passages that already start in a document with a smaller id.

A window is ``width`` consecutive words of one document. A word goes if it lies in a
window whose word sequence also starts in a document with a smaller ``doc_id``.

Method: a count-min sketch of windows is built per partition and merged, and only
windows whose merged estimate is 2 or more are grouped exactly. The sketch has one
row whose width follows the size of the corpus, so that few unique windows share a
counter at any size. It is stored sparsely (sorted counters as 16-bit gaps, or as they are
where they lie far apart; counts saturating at 2) and merged in slices of the counter
range. There is a slice for each ``SLICE_BYTES`` of text, so a task holds one slice of
bounded size and nothing is broadcast. An estimate is never below the true count;
so no repeated window is lost.

Every step answers a *block* of documents (those of one input file, or a hash part of
a large file): the merged sketch tells a block which of its counters repeat, the
exact grouping, by 96 bits of hash, tells it the smallest id of each repeated window. Answers are written
to the shared scratch folder, one directory a block, and a task reads the answer to
its own block only.

Cases: null text has no words. A null id counts as larger than every id. Rows that
share an id count as one document, so they never remove each other's words. Texts
with fewer than ``width`` words lose nothing. An empty table gives an empty result.
Columns of the input other than ``doc_id`` and ``text`` matter only if passed on by
``keep``; the names that this operator adds replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from counterlens.llm import kernel as K
from counterlens.llm.shared import Scratch

WIDTH = 13
LEAST_SLICES = 64
SLICE_BYTES = 24 << 20
MOST_BITS = 52
BLOCK_BYTES = 128 << 20
FLUSH = 2_000_000
NO_ID = np.iinfo(np.int64).max
BLOCK = "__block"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        blocks = batch.column(BLOCK).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                for part in K.chunks(iter([batch.slice(a, b - a)]), "text"):
                    yield int(blocks[a]), part


def _windows(part: pa.RecordBatch, width: int):
    """Word hashes, first word of each document, window hashes and their first words."""
    buf, offs = K.utf8(part.column("text"))
    starts, ends, first = K.words(buf, offs)
    hashes = K.hash_segments(buf, starts, ends)
    return (buf, starts, ends, first, hashes, *K.rolling(hashes, first, width, 7))


def _second(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A further 32 bits of hash for the windows that start at the given words."""
    factors = K.stream(8, width) | K.U64(1)
    out = np.zeros(len(at), K.U64)
    for j in range(width):
        out += hashes[at + j] * factors[j]
    return (K.mix(out) >> K.U64(32)).astype(np.uint32)


def _load(uri: str, block: int) -> pa.Table | None:
    fs, path = pafs.FileSystem.from_uri(uri)
    folder = f"{path}/block={block}"
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return None
    return pq.read_table(folder, filesystem=fs, partitioning=None)


def _sketch(width: int, log_w: int, slice_bits: int):
    """Task side of the first pass: sparse saturating sketches by slice."""
    schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("counters", pa.binary())])

    def flush(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        c = np.sort(np.concatenate(held))
        third = np.zeros(len(c), bool)
        third[2:] = c[2:] == c[:-2]
        c = c[~third]
        part = (c >> np.uint64(slice_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [(int(part[a]), K.pack_gaps(c[a:b] & K.U64((1 << slice_bits) - 1))) for a, b in zip(cuts, [*cuts[1:], len(c)])]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current = [], 0, None
        for block, part in _by_block(batches):
            if size and (block != current or size >= FLUSH):
                yield flush(current, held)
                held, size = [], 0
            current = block
            *_, first, _hashes, h, at = _windows(part, width)
            if not len(h):
                continue
            # a counter rises once for each document
            c = h >> K.U64(64 - log_w)
            room = 64 - log_w
            doc = K.doc_of(first)[at].astype(K.U64)
            if int(doc[-1]) >> room:  # no room for both in one word
                order = np.lexsort((doc, c))
                c, doc = c[order], doc[order]
                once = c[np.concatenate(([True], (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])))]
            else:
                key = np.sort((c << K.U64(room)) | doc)
                once = key[np.concatenate(([True], key[1:] != key[:-1]))] >> K.U64(room)
            held.append(once)
            size += len(once)
        if size:
            yield flush(current, held)

    return run


def _groups(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return zip(owner[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(owner)])


def _merge_sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One slice: which of its counters reach 2, told to every block that has them."""
    rows = [K.unpack_gaps(x.as_py()) for x in table["counters"]]
    owner, counter = np.repeat(table["block"].to_numpy(), [len(r) for r in rows]), np.concatenate(rows)
    order = np.argsort(counter, kind="stable")
    owner, counter = owner[order], counter[order]
    same = counter[1:] == counter[:-1]
    hot = np.append(False, same) | np.append(same, False)
    owner, counter = owner[hot], counter[hot]
    order = np.argsort(owner, kind="stable")  # counters of a block stay in order
    owner, counter = owner[order], counter[order]
    out = [(block, K.pack_gaps(np.unique(counter[a:b]))) for block, a, b in _groups(owner)]
    return pa.table({"slice": pa.array([key[0].as_py()] * len(out), pa.int32()), "block": pa.array([b for b, _ in out], pa.int64()), "counters": pa.array([c for _, c in out], pa.binary())})


def _ask(uri: str, width: int, log_w: int, slice_bits: int):
    """Task side of the second pass: windows estimated repeated, with the smallest id here."""
    schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("hash", pa.binary()), ("more", pa.binary()), ("low", pa.binary()), ("several", pa.binary())])

    def hot_of(block: int) -> np.ndarray:
        table = _load(uri, block)
        if table is None:
            return np.zeros(0, K.U64)
        order = np.argsort(table["slice"].to_numpy())
        rows = [K.unpack_gaps(table["counters"][int(i)].as_py()).astype(K.U64) | (K.U64(table["slice"][int(i)].as_py()) << K.U64(slice_bits)) for i in order]
        return np.concatenate(rows)

    def flush(block: int, held: list[tuple]) -> pa.RecordBatch:
        h, g, d = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((d, g, h))
        h, g, d = h[order], g[order], d[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(h)) - 1
        several = (d[begin] != d[last]).astype(np.uint8)
        h, g, d = h[begin], g[begin], d[begin]
        part = (h >> K.U64(64 - log_w + slice_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(cuts, [*cuts[1:], len(h)]))
        cols = [pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64())]
        cols += [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (h, g)]
        cols += [pa.array([_pack_ids(d[a:b]) for a, b in spans], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary())]
        return pa.record_batch(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current, hot = [], 0, None, None
        for block, part in _by_block(batches):
            if size and (block != current or size >= FLUSH // 2):
                yield flush(current, held)
                held, size = [], 0
            if block != current:
                current, hot = block, hot_of(block)
            if not len(hot):
                continue
            *_, first, hashes, h, at = _windows(part, width)
            found = _find(hot, h >> K.U64(64 - log_w)) >= 0
            at, h = at[found], h[found]
            if len(h):
                held.append((h, _second(hashes, at, width), _ids(part)[K.doc_of(first)[at]]))
                size += len(h)
        if size:
            yield flush(current, held)

    return run


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as 32-bit offsets from the smallest where they fit, else as they are."""
    base = int(ids.min()) if len(ids) else 0
    small = len(ids) and int(ids.max()) - base < 1 << 32
    body = (ids - base).astype("<u4") if small else ids.astype("<i8")
    return np.array([4 if small else 8, base], "<i8").tobytes() + body.tobytes()


def _unpack_ids(data: bytes) -> np.ndarray:
    width, base = np.frombuffer(data, "<i8", 2)
    body = np.frombuffer(data, "<u4" if width == 4 else "<i8", offset=16)
    return body.astype(np.int64) + base if width == 4 else body


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    at[keys[at] != wanted] = -1
    return at


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One slice: the smallest id of each window, told to blocks that hold a larger one."""
    blocks = table["block"].to_numpy()
    rows = [[np.frombuffer(table[c][i].as_py(), t) for c, t in (("hash", "<u8"), ("more", "<u4"))] + [_unpack_ids(table["low"][i].as_py())] for i in range(len(blocks))]
    several = np.concatenate([np.unpackbits(np.frombuffer(table["several"][i].as_py(), np.uint8), count=len(rows[i][0])) for i in range(len(blocks))]).astype(bool)
    h, g, d = (np.concatenate(x) for x in zip(*rows))
    owner = np.repeat(blocks, [len(r[0]) for r in rows])
    order = np.lexsort((g, h))
    h, g, d, several, owner = h[order], g[order], d[order], several[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    low = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(h))))
    told = several | (low < d)
    h, g, low, owner = h[told], g[told], low[told], owner[told]
    order = np.argsort(owner, kind="stable")  # windows of a block stay in order
    h, g, low, owner = h[order], g[order], low[order], owner[order]
    out = []
    for block, a, b in _groups(owner):
        one = np.flatnonzero(np.concatenate(([True], (h[a + 1 : b] != h[a : b - 1]) | (g[a + 1 : b] != g[a : b - 1])))) + a
        out.append((block, h[one].tobytes(), g[one].tobytes(), _pack_ids(low[one])))
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table({"slice": pa.array([key[0].as_py()] * len(out), pa.int32()), "block": pa.array(cols[0], pa.int64()), "hash": pa.array(cols[1], pa.binary()), "more": pa.array(cols[2], pa.binary()), "low": pa.array(cols[3], pa.binary())})


def join_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each document's words joined by one space, as a string column."""
    lengths = ends - starts
    steps = lengths + 1
    filled = np.flatnonzero(np.diff(first))
    steps[first[filled + 1] - 1] -= 1
    places = np.concatenate(([0], np.cumsum(steps)))
    out = np.full(int(places[-1]), 0x20, np.uint8)
    if len(starts):
        shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        src = np.arange(int(lengths.sum())) + shift
        dst = src + np.repeat(places[:-1] - starts, lengths)
        out[dst] = buf[src]
    offsets = places[first].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])


def _cut(uri: str, width: int, schema: pa.Schema):
    """Task side of the last pass: words to remove, and what is left."""

    def told(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = _load(uri, block)
        if table is None:
            return np.zeros(0, K.U64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order = np.argsort(table["slice"].to_numpy())
        rows = [(np.frombuffer(table["hash"][int(i)].as_py(), "<u8"), np.frombuffer(table["more"][int(i)].as_py(), "<u4"), _unpack_ids(table["low"][int(i)].as_py())) for i in order]
        return tuple(np.concatenate(x) for x in zip(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, more, lows = None, None, None, None
        for block, part in _by_block(batches):
            if block != current:
                current, (keys, more, lows) = block, told(block)
            buf, starts, ends, first, hashes, h, at = _windows(part, width)
            goes = np.zeros(len(starts) + 1, np.int32)
            if len(keys) and len(h):
                place = np.searchsorted(keys, h)
                hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == h)
                place, want = place[hit], _second(hashes, at[hit], width)
                # windows of one first hash lie together, by their second
                left = np.flatnonzero(more[place] != want)
                while len(left):
                    place[left] += 1
                    left = left[place[left] < len(keys)]
                    left = left[(keys[place[left]] == h[hit[left]]) & (more[place[left]] != want[left])]
                sure = place < len(keys)
                sure[sure] = (keys[place[sure]] == h[hit[sure]]) & (more[place[sure]] == want[sure])
                gone, place = hit[sure], place[sure]
                gone = gone[lows[place] < _ids(part)[K.doc_of(first)[at[gone]]]]
                np.add.at(goes, at[gone], 1)
                np.add.at(goes, at[gone] + width, -1)
            keep = np.cumsum(goes[:-1]) == 0
            kept = np.concatenate(([0], np.cumsum(keep)))
            text = join_words(buf, starts[keep], ends[keep], kept[first])
            n = np.diff(first)
            made = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(kept[first]), pa.int64()), "kept_text": text}
            yield pa.record_batch([(made[f.name] if f.name in made else part.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    ``keep`` names further columns of ``docs`` to pass on. The result reads tables in
    ``scratch``; drop those only when the result has been stored.
    """
    docs = docs.select("doc_id", "text", *[c for c in keep or [] if c not in ("doc_id", "text", "n_words", "n_removed", "kept_text")])
    # blocks are input files; rows that come from no file are stored first
    if docs.select(F.input_file_name().alias("f")).where("f = ''").limit(1).count():
        docs = scratch.table(docs, "input")
    file = F.xxhash64(F.input_file_name())
    sizes = docs.select(file.alias("f"), F.octet_length("text").alias("b")).groupBy("f").agg(F.sum("b").alias("b")).agg(F.sum("b"), F.max("b")).first()
    total, largest = sizes[0] or 0, sizes[1] or 0
    log_w = min(MOST_BITS, max(24, math.ceil(math.log2(4 * total + 1))))
    slices = max(LEAST_SLICES, math.ceil(total / SLICE_BYTES))
    slice_bits = max(log_w - 31, log_w - math.ceil(math.log2(slices)))
    parts = math.ceil(largest / BLOCK_BYTES)
    if parts > 1:
        blocks = docs.withColumn(BLOCK, F.xxhash64(F.input_file_name(), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))).sortWithinPartitions(BLOCK)
    else:
        blocks = docs.withColumn(BLOCK, file)
    slim = blocks.select(BLOCK, "doc_id", "text")
    sketches = slim.mapInArrow(_sketch(width, log_w, slice_bits), "slice int, block long, counters binary")
    merged = sketches.groupBy("slice").applyInArrow(_merge_sketch, "slice int, block long, counters binary")
    scratch.table(merged.repartition("block"), "hot", partition_by="block")
    asked = slim.mapInArrow(_ask(scratch.path("hot"), width, log_w, slice_bits), "slice int, block long, hash binary, more binary, low binary, several binary")
    answers = asked.groupBy("slice").applyInArrow(_answer, "slice int, block long, hash binary, more binary, low binary")
    scratch.table(answers.repartition("block"), "told", partition_by="block")
    scratch.drop("hot")
    out = docs.drop(BLOCK).withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).withColumn("kept_text", F.lit(""))
    return blocks.mapInArrow(_cut(scratch.path("told"), width, to_arrow_schema(out.schema)), out.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, Scratch(spark, "substring"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), k AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p
), f AS (
  SELECT s, min(doc_id) AS low FROM k GROUP BY s
), g AS (
  SELECT DISTINCT k.doc_id, k.i + j.j AS pos FROM k JOIN f USING (s), range(0, 13) AS j(j) WHERE f.low < k.doc_id
), gone AS (
  SELECT doc_id, list(pos) AS hit FROM g GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(hit), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT coalesce(list_contains(hit, x), FALSE)), lambda x: ws[x]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""
