r"""Removal of lines that many documents hold, told as one bitmap a document.

A line's key is the line without white space ``[\x20\x09-\x0D]`` at both ends, with A-Z
lower-cased. A key of at least ``min_chars`` code points that ``min_docs`` documents hold
loses its lines in all of them but the one with the largest id.

Method: every long line becomes (128 bits of hash, document, position). These are dealt by
ranges of hash and document and sorted by hash, document (largest first) and position, so a
task streams each key's lines with their first document in front, and keeps no more of a
key than the lines of its first ``min_docs`` documents. A key that is in very many documents
fills several ranges. What a task cannot tell alone, as it concerns the first or last key of
its range, it passes on with how many documents of that key it saw; those counts, two at
most a range, are added and broadcast.

The result holds no text: ``keep_bits`` of a document has one bit a line (1: stays), packed
from the highest bit of each byte and compressed by zlib, and is null where all lines stay.
``kept_text`` applies it.

Cases: null and empty texts have one empty line. Rows that share an id are one document,
whose lines are judged together. Rows without an id are below every id; those with equal
texts are one document. Texts, lines and positions may be of any length. Equal lines of the
document that keeps a key all stay. An empty table gives an empty result. Columns of the
input other than ``doc_id`` and ``text`` matter only if passed on by ``keep``; the names
that this operator adds replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from counterlens.llm import kernel as K
from counterlens.llm.shared import Scratch

MIN_CHARS = 40
MIN_DOCS = 5
RANGE_ROWS = 2_000_000
LONG_LINE = 1 << 16
NO_ID = np.iinfo(np.int64).min
#: What becomes of a line: it goes, its range cannot tell, or (not a line) what a range saw of a key.
GOES, OPEN, SEEN = 0, 1, 2

ENTRY = "h1 long, h2 long, doc long, own long, print long, n_lines int, pos int"
JUDGED = f"kind int, docs long, {ENTRY}"
FIELDS = ("h1", "h2", "doc", "own", "print", "n_lines", "pos")


def long_lines(column: pa.Array, min_chars: int) -> tuple[np.ndarray, ...]:
    """Document, place in it, two hashes of the key of every line with ``min_chars`` code points; and each document's number of lines."""
    buf, offs = K.utf8(column)
    breaks = np.flatnonzero(buf == 0x0A)
    per_doc = np.diff(np.searchsorted(breaks, offs)) + 1
    doc = np.repeat(np.arange(len(offs) - 1), per_doc)
    first = np.concatenate(([0], np.cumsum(per_doc)))
    starts = np.zeros(int(first[-1]), np.int64)
    starts[first[:-1]] = offs[:-1]
    other = np.ones(len(starts), bool)
    other[first[:-1]] = False
    starts[other] = breaks + 1
    ends = np.zeros(len(starts), np.int64)
    ends[first[1:] - 1] = offs[1:]
    other[:] = True
    other[first[1:] - 1] = False
    ends[other] = breaks
    solid = np.flatnonzero(~K.IS_SPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    filled = np.flatnonzero(b > a)
    begin, end = solid[a[filled]], solid[b[filled] - 1] + 1
    long = points[end] - points[begin] >= min_chars
    at, begin, end = filled[long], begin[long], end[long]
    lower = K.LOWER[buf]
    h1, h2 = np.zeros(len(at), K.U64), np.zeros(len(at), K.U64)
    usual = end - begin <= LONG_LINE
    for out, seed in ((h1, 1), (h2, 2)):
        out[usual] = K.hash_segments(lower, begin[usual], end[usual], seed)
    for i in np.flatnonzero(~usual):
        h1[i], h2[i] = np.frombuffer(hashlib.blake2b(lower[begin[i] : end[i]].tobytes(), digest_size=16).digest(), K.U64)
    return doc[at], at - first[doc[at]], h1.view(np.int64), h2.view(np.int64), per_doc


def _entries(schema: pa.Schema, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, "text", owner="lines"):
            doc, pos, h1, h2, n_lines = long_lines(part.column("text"), min_chars)
            of = lambda name: part.column(name).to_numpy()[doc]
            made = {"h1": h1, "h2": h2, "doc": of("doc"), "own": of("own"), "print": of("print"), "n_lines": n_lines[doc], "pos": pos}
            yield pa.record_batch([pa.array(made[f.name]).cast(f.type) for f in schema], schema=schema)

    return run


class _Run:
    """The lines of one key in one range, as far as they have come."""

    def __init__(self, border: bool, min_docs: int):
        self.border, self.min_docs = border, min_docs
        self.docs, self.first, self.last, self.held = 0, None, None, []

    def add(self, rows: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        doc, own = rows["doc"], rows["own"]
        self.first = self.first or (doc[0], own[0])
        new = np.append(self.last != (doc[0], own[0]), (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]))
        self.docs, self.last = self.docs + int(new.sum()), (doc[-1], own[-1])
        if self.border:
            yield OPEN, rows
            return
        later = (doc != self.first[0]) | (own != self.first[1])
        self.held.append({k: v[later] for k, v in rows.items()})
        if self.docs >= self.min_docs:
            yield from self._held(GOES)

    def _held(self, kind: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        yield from ((kind, x) for x in self.held)
        self.held = []

    def close(self, last: bool) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """What remains to be said once the key's lines in this range are over; ``last``: the next range may have more."""
        if last and not self.border:
            yield from self._held(OPEN)
        if last or self.border:
            yield SEEN, {"doc": np.array([self.first[0]]), "own": np.array([self.first[1]])}


def judged(batches: Iterator[dict[str, np.ndarray]], min_docs: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(kind, documents, lines) of one range's lines in order, in arrays by name; documents only with SEEN."""
    run, key = None, None
    for rows in batches:
        h1, h2 = rows["h1"], rows["h2"]
        if not len(h1):
            continue
        new = np.append(key != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        cuts = np.append(np.flatnonzero(new), len(h1))
        piece = lambda a, b: {k: v[a:b] for k, v in rows.items()}
        if cuts[0]:
            yield from ((kind, 0, x) for kind, x in run.add(piece(0, cuts[0])))
        if len(cuts) == 1:
            continue
        begin = 0
        if run is None:  # the range's first key
            run, key = _Run(True, min_docs), (h1[0], h2[0])
            yield from ((kind, 0, x) for kind, x in run.add(piece(0, cuts[1])))
            begin = 1
            if len(cuts) == 2:
                continue
        yield from _closed(run, key, False)
        # keys that begin and end here
        a, b = cuts[begin], cuts[-2]
        if a < b:
            inner = piece(a, b)
            key_of = np.cumsum(new[a:b]) - 1
            at = np.flatnonzero(new[a:b])
            doc, own = inner["doc"], inner["own"]
            step = np.append(True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])) | new[a:b]
            many = np.bincount(key_of, step) >= min_docs
            goes = many[key_of] & ((doc != doc[at][key_of]) | (own != own[at][key_of]))
            yield GOES, 0, {k: v[goes] for k, v in inner.items()}
        run, key = _Run(False, min_docs), (h1[b], h2[b])
        yield from ((kind, 0, x) for kind, x in run.add(piece(b, len(h1))))
    if run:
        yield from _closed(run, key, True)


def _closed(run: _Run, key: tuple, last: bool) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    for kind, rows in run.close(last):
        if kind == SEEN:
            zero = np.zeros(1, np.int64)
            rows = rows | {"h1": np.array([key[0]]), "h2": np.array([key[1]]), "print": zero, "n_lines": zero, "pos": zero}
        yield kind, run.docs if kind == SEEN else 0, rows


def _judge(schema: pa.Schema, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("lines")
        for kind, docs, rows in judged(({c: b.column(c).to_numpy() for c in FIELDS} for b in batches), min_docs):
            if n := len(rows["pos"]):
                made = rows | {"kind": np.full(n, kind), "docs": np.full(n, docs)}
                yield pa.record_batch([pa.array(made[f.name]).cast(f.type) for f in schema], schema=schema)

    return run


def _bits(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, gone = [], []
            for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("gone")):
                stays = np.ones(n, bool)
                stays[at.values.to_numpy()] = False
                bits.append(zlib.compress(np.packbits(stays).tobytes()))
                gone.append(n - int(stays.sum()))
            made = {"__doc": batch.column("doc"), "__print": batch.column("print"), "n_dropped": pa.array(gone, pa.int64()), "keep_bits": pa.array(bits, pa.binary())}
            yield pa.record_batch([made[f.name] for f in schema], schema=schema)

    return run


def dedup_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and keep_bits of every row of ``docs``.

    ``keep`` names further columns to pass on; without ``text`` among them no text is shuffled.
    """
    spark = docs.sparkSession
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    id_ = F.col("doc_id").cast("long")
    print_ = F.xxhash64("text")
    slim = docs.where(F.octet_length("text") >= min_chars).select("text", F.coalesce(id_, F.lit(NO_ID)).alias("doc"), F.when(id_.isNull(), print_).otherwise(F.lit(0)).alias("own"), print_.alias("print"))
    lines = scratch.table(slim.mapInArrow(_entries(arrow(ENTRY), min_chars), ENTRY), "lines")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / RANGE_ROWS))
    by = ["h1", "h2", F.desc("doc"), F.desc("own")]
    ordered = lines.repartitionByRange(ranges, *by).sortWithinPartitions(*by, "print", "pos")
    told = scratch.table(ordered.mapInArrow(_judge(arrow(JUDGED), min_docs), JUDGED), "told")
    # at most two rows a range
    seen = told.where(F.col("kind") == SEEN).groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.max(F.struct("doc", "own")).alias("largest")).where(F.col("all") >= min_docs)
    late = told.where(F.col("kind") == OPEN).join(F.broadcast(seen), ["h1", "h2"]).where(F.struct("doc", "own") < F.col("largest"))
    columns = ["doc", "print", "n_lines", "pos"]
    gone = told.where(F.col("kind") == GOES).select(*columns).unionByName(late.select(*columns))
    # rows with one id and one text are told the same
    of_doc = gone.groupBy("doc", "print").agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    bits_ddl = "__doc long, __print long, n_dropped long, keep_bits binary"
    bits = of_doc.mapInArrow(_bits(arrow(bits_ddl)), bits_ddl)

    made = ["n_lines", "n_dropped", "keep_bits"]
    passed = [c for c in keep or [] if c not in ("doc_id", *made)]
    count = F.coalesce(F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    some = F.coalesce(F.octet_length("text") >= min_chars, F.lit(False))
    # a text without a long line meets nothing; its place is its own, so that such texts do not meet in one task either
    left = docs.select(id_.alias("doc_id"), *passed, count.cast("long").alias("n_lines"), F.when(some, F.coalesce(id_, F.lit(NO_ID))).otherwise(F.monotonically_increasing_id()).alias("__doc"), F.when(some, print_).alias("__print"))
    out = left.join(bits, ["__doc", "__print"], "left")
    return out.select("doc_id", *passed, "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep_bits")


def _kept(schema: pa.Schema):
    def text_of(text: str | None, bits: bytes | None) -> str:
        if bits is None:
            return text or ""
        lines = (text or "").split("\n")
        stays = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
        return "\n".join([lines[i] for i in np.flatnonzero(stays).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, "text", owner="lines"):
            kept = [text_of(t, b) for t, b in zip(part.column("text").to_pylist(), part.column("keep_bits").to_pylist())]
            yield pa.record_batch([pa.array(kept, f.type) if f.name == "kept_text" else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def kept_text(judged_docs: DataFrame) -> DataFrame:
    """``judged_docs`` (with text and keep_bits) with kept_text: the lines that stay, joined by line breaks."""
    out = judged_docs.drop("kept_text").withColumn("kept_text", F.lit(""))
    return judged_docs.drop("kept_text").mapInArrow(_kept(to_arrow_schema(out.schema)), out.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = kept_text(dedup_lines(docs, Scratch(spark, "lines"), keep=["text"]))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT doc_id, pos, line, last IS NOT NULL AND doc_id < last AS goes FROM k LEFT JOIN m USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
