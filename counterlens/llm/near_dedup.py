"""Near-duplicate documents by HyperMinHash sketches, with exact confirmation.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A document's
set holds its distinct shingles of ``words`` consecutive words (a shorter document's
whole sequence is its one shingle). Documents are linked if 100 * intersection >=
percent * union.

Method. Shingle hashes fall into 128 buckets; a bucket stores, in 16 bits, the leading
zeros and ten mantissa bits of its smallest hash. Buckets that stay empty borrow the
register of another bucket by a fixed order. 25 bands of 5 registers make candidates:
at a similarity of 0.85 a pair shares no band with probability below 1e-6. A pair is
kept if the Jaccard estimate, corrected for chance agreement of registers, is within
six standard errors of the threshold, and confirmed on the full sets of hashes.

Documents of equal sets form one class, and only its smallest id goes on, so thousands
of copies cost one row each. In a band's bucket every member is compared with the
bucket's smallest id. Documents that buckets tie together form a cluster; in a cluster
that confirmed links leave in parts, the parts are compared with each other by exact
overlap counts, in blocks of bounded size. The cluster's largest part is dealt to blocks
of its own, which meet only blocks of the other parts. So no bucket is capped, no pair
inside a part is looked at again, and only links between parts are listed. The work grows
with the documents outside the largest part times those of the cluster.

Joins on a bucket, a cluster or a head of many pairs are salted, or the few heavy keys are
broadcast with a number or two each, so no task holds one whole.

Cases: a document without words has an empty set, links with nothing and is kept.
Null text is empty. A row without an id takes no part and is kept, its component_id
null. Each row is judged by its own text; rows that share an id are one vertex. An
empty table gives an empty result. Only doc_id and text are read; further columns,
whatever their names, are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm import kernel as K
from counterlens.llm.graph import LINKS_A_TASK, components
from counterlens.llm.shared import HOT, Scratch, salted, with_each

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BANDS = 25
ROWS = 5
WORDS = 5
PERCENT = 80
BLOCK_SHINGLES = 2_000_000
BLOCK_ROWS = 1_000
PAIRS_A_TASK = 1_000


def shingles(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and each document's offset."""
    buf, offs = K.utf8(part.column("text"))
    buf = K.LOWER[buf]
    starts, ends, first = K.words(buf, offs)
    hashes = K.hash_segments(buf, starts, ends)
    doc = K.doc_of(first)
    every, owner = [], []
    h, at = K.rolling(hashes, first, words, 3)
    every.append(h)
    owner.append(doc[at])
    count = np.diff(first)
    for n in range(1, words):  # documents shorter than a shingle
        few = np.flatnonzero(count == n)
        if len(few):
            factors = K.stream(40 + n, n) | K.U64(1)
            out = np.zeros(len(few), K.U64)
            for j in range(n):
                out += hashes[first[few] + j] * factors[j]
            every.append(K.mix(out))
            owner.append(few)
    h, d = np.concatenate(every), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(first)))


_BORROW = np.stack([np.argsort(K.stream(500 + j, BUCKETS), kind="stable") for j in range(BUCKETS)])


def registers(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, a row of 128 for each document; 0 only where the set is empty."""
    n = len(offs) - 1
    regs = np.zeros((n, BUCKETS), np.uint16)
    if not len(h):
        return regs
    doc = np.repeat(np.arange(n), np.diff(offs))
    bucket = (h >> K.U64(64 - BUCKET_BITS)).astype(np.int64)
    cell = doc * BUCKETS + bucket
    low = np.flatnonzero(np.diff(cell, prepend=-1))  # sorted, so the first of a cell is its smallest
    part, power = np.frexp((h[low] << K.U64(BUCKET_BITS)).astype(np.float64))
    zeros = np.minimum(64 - power, 62) + 1
    mantissa = np.clip((part - 0.5) * (2 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
    regs.reshape(-1)[cell[low]] = (zeros << MANTISSA_BITS) | mantissa
    own = regs != 0
    for t in range(BUCKETS):
        rows, cols = np.nonzero((regs == 0) & own.any(axis=1, keepdims=True))
        if not len(rows):
            break
        from_ = _BORROW[cols, t]
        good = own[rows, from_]
        regs[rows[good], cols[good]] = regs[rows[good], from_[good]]
    return regs


def _sketch(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, "text"):
            h, offs = shingles(part, words)
            regs = registers(h, offs)
            filled = np.flatnonzero(np.diff(offs))
            marks = np.zeros((2, len(offs) - 1), K.U64)
            if len(filled):
                marks[0, filled] = np.add.reduceat(K.mix(h), offs[filled])
                marks[1, filled] = np.add.reduceat(K.mix(h ^ K.U64(0x5DEECE66D1234567)), offs[filled])
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offs), pa.int64()), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())],
                schema=schema,
            )

    return run


def _sets(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, "text"):
            h, offs = shingles(part, words)
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(offs, offs[1:])], pa.binary())], schema=schema)

    return run


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that two registers of unrelated minima agree."""
    edge = 2.0 ** -np.arange(0, 65)
    per = [np.maximum(n / BUCKETS, 1.0)[:, None] for n in (n_a, n_b)]
    below = [1 - (1 - edge[None, :]) ** k for k in per]
    mass = [b[:, :-1] - b[:, 1:] for b in below]
    return (mass[0] * mass[1]).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less what chance gives."""
    share = (regs_a == regs_b).mean(axis=1)
    c = chance(n_a, n_b)
    return np.clip((share - c) / (1 - c), 0, 1)


def _screen(percent: int):
    """Candidate pairs whose estimate does not rule the link out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    j = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                regs = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b")]
                n = [part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
                filled = BUCKETS * (1 - np.exp(-np.minimum(*n) / BUCKETS))
                near = estimate(*regs, *n) >= j - 6 * np.sqrt(j * (1 - j) / np.maximum(filled, 1))
                yield pa.record_batch([part.column("a").filter(pa.array(near)), part.column("b").filter(pa.array(near))], schema=schema)

    return run


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("set_a"), part.column("set_b")):
                u, v = (np.frombuffer(s.as_buffer(), K.U64) for s in (x, y))
                both = np.concatenate((u, v))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([part.column("a").filter(mask), part.column("b").filter(mask)], schema=schema)

    return run


def _across(percent: int):
    """Links between components inside one block of a cluster, by exact overlap counts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, roots, chunk = (table[c].to_numpy() for c in ("doc_id", "root", "chunk"))
        sets = [np.frombuffer(x.as_buffer(), K.U64) for x in table["shingles"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        owner, begin = owner[order], np.flatnonzero(np.diff(flat[order], prepend=flat[order][:1] ^ K.U64(1)))
        ends = np.append(begin[1:], len(flat))
        term = np.empty(len(flat), np.int64)
        term[order] = np.repeat(np.arange(len(begin)), ends - begin)
        at = np.concatenate(([0], np.cumsum(sizes)))
        names, members = np.unique(roots, return_counts=True)
        rest = np.flatnonzero(roots != names[members.argmax()])  # the largest part needs no asking
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for x in rest.tolist():
            terms = term[at[x] : at[x + 1]]
            n = ends[terms] - begin[terms]
            post = np.arange(int(n.sum())) + np.repeat(begin[terms] - (np.cumsum(n) - n), n)
            shared = np.bincount(owner[post], minlength=len(sets))
            near = 100 * shared >= percent * (sizes + sizes[x] - shared)
            for y in np.flatnonzero(near & (roots != roots[x])).tolist():
                found.setdefault((min(roots[x], roots[y]), max(roots[x], roots[y])), (int(ids[x]), int(ids[y])))
        return pa.table([pa.array([a for a, _ in found.values()], pa.int64()), pa.array([b for _, b in found.values()], pa.int64())], schema=schema)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return run(key, table) if len(table["root"].unique()) > 1 else schema.empty_table()

    return compare


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.table(docs.mapInArrow(_sketch(words), "doc_id long, n long, s1 long, s2 long, regs binary"), "sketches")
    linkable = sketches.where("n > 0 AND doc_id IS NOT NULL")
    reps = scratch.table(linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("regs").alias("regs"), F.count("*").alias("copies")), "reps")
    # a candidate pair is a bucket's smallest id and another of its members
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    bands = reps.select(band.alias("band"), "doc_id")
    heads = bands.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).where("m > 1")
    n_reps = reps.count()
    # a task can hold a bucket of a small table; of a large one the heavy buckets' heads are broadcast
    met = bands.join(heads.drop("m"), "band") if BANDS * n_reps <= LINKS_A_TASK else with_each(bands, scratch.table(heads, "heads"), ["band"], "m", BANDS * n_reps)
    pairs = met.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs")
    n_pairs = pairs.count()
    clusters = components(pairs, scratch, "clusters").select(F.col("u").alias("doc_id"), F.col("v").alias("cluster"))
    # every member of a cluster, with its full set
    clusters = scratch.table(clusters.unionByName(clusters.select(F.col("cluster").alias("doc_id"), "cluster").distinct()), "clustered")
    sets = scratch.table(docs.join(clusters, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles binary"), "sets")
    # sizes, then sketches, then full sets decide about candidates
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = sized.mapInArrow(_screen(percent), "a long, b long")
    set_of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    near = scratch.table(near, "near")
    weights = near.groupBy("a").agg(F.count("*").alias("w"))
    met = salted(near.join(set_of("b"), "b"), set_of("a"), "a", weights, max(PAIRS_A_TASK, n_pairs // HOT))
    links = scratch.table(met.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")
    roots = components(links, scratch, "first").select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
    # clusters that are still in parts: their parts are compared by exact overlaps
    placed = clusters.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).join(reps.select("doc_id", "n"), "doc_id")
    placed = scratch.table(placed, "placed")
    parts = placed.groupBy("cluster", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    parts = parts.groupBy("cluster").agg(F.max(F.struct("rows", F.col("root"), "size")).alias("big"), F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda rows, size: F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS)), F.ceil(size / F.lit(BLOCK_SHINGLES))).cast("int")
    open_ = parts.select("cluster", "rows", F.col("big.root").alias("big"), blocks(F.col("rows") - F.col("big.rows"), F.col("size") - F.col("big.size")).alias("rest"), blocks(F.col("big.rows"), F.col("big.size")).alias("mass"))
    n_placed = placed.count()
    met = placed.join(open_.drop("rows"), "cluster") if n_placed <= LINKS_A_TASK else with_each(placed, scratch.table(open_, "open"), ["cluster"], "rows", n_placed).where("rest IS NOT NULL").drop("rows")
    # chunks 0 to rest - 1 are of the smaller parts, the others of the largest; two of the largest do not meet
    of_big = F.col("root") == F.col("big")
    chunk = F.when(of_big, F.col("rest") + F.pmod(F.xxhash64("doc_id"), F.col("mass"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("rest"))).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(of_big, F.col("rest")).otherwise(F.col("rest") + F.col("mass")) - 1)))
    placed = met.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc_id", "root").join(sets, "doc_id")
    more = scratch.table(placed.groupBy("cluster", "i", "j").applyInArrow(_across(percent), "a long, b long"), "more")
    scratch.drop("sets")
    if more.limit(1).count():
        edges = roots.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = components(edges, scratch, "second").select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
    # copies of one text may be very many, and so may documents that are linked with nothing
    classes = scratch.table(reps.join(roots, "doc_id", "left").select("s1", "s2", F.coalesce("root", "doc_id").alias("root"), "copies"), "classes")
    slim = sketches.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
    can = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linked = with_each(slim.where(can), classes, ["s1", "s2"], "copies", classes.agg(F.sum("copies")).first()[0] or 0)
    alone = slim.where(~can).withColumn("root", F.col("doc_id"))
    out = linked.select("doc_id", "n_shingles", "root").unionByName(alone.select("doc_id", "n_shingles", "root"))
    return out.select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, Scratch(spark, "near"), words=3, percent=85)
