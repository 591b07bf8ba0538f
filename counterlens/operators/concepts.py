"""Concepts in texts by dictionary, all in one pass.

A concept is a set of wordings. A match is a wording at a word's bounds, letters A-Z in any
case; of wordings that begin at one place the longest counts, and matches of one concept do
not overlap: they are taken from the left, as a regular expression of alternatives would.
Concepts do not disturb each other. An automaton finds all wordings of all concepts in time
that follows the text, however many there are.

The dictionary is dealt in parts of bounded size; each is broadcast and passes the texts
once, so a dictionary of any size works, in more passes. A task holds one batch of texts, the
wordings near the place that it reads, and one block of what it found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of wordings in one automaton; it takes some hundred bytes each.
PART_CHARS = 2_000_000
#: Rows of a block that a task gives out at once.
BLOCK_ROWS = 10_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def wordings(synonyms: Sequence[str], variants: Sequence[str] = (), stop: Sequence[str] = (), least: int = 3, name: str = "") -> list[str]:
    """Synonyms of at least ``least`` characters that are no stop words, and all variants; without any, the concept's name."""
    stopped = {s.lower() for s in stop}
    return [s for s in synonyms if len(s) >= least and s.lower() not in stopped] + list(variants) or [name]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Matcher:
    """An automaton over the wordings of concepts. ``tails`` are patterns that must follow a concept's wording, such as a number."""

    def __init__(self, concepts: Mapping[str, Sequence[str]], tails: Mapping[str, str] | None = None):
        import ahocorasick

        self.names = list(concepts)
        self.tails = {i: re.compile(tails[c]) for i, c in enumerate(self.names) if tails and c in tails}
        owners: dict[str, list[int]] = {}
        for i, c in enumerate(self.names):
            for w in dict.fromkeys(x.translate(_LOWER) for x in concepts[c] if x):
                owners.setdefault(w, []).append(i)
        self.longest = max(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton()
        for w, who in owners.items():
            self.automaton.add_word(w, (len(w), tuple(who)))
        if owners:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """Number of the concept, start and stop of its matches by start, found as the text is read: only wordings near the place are held."""
        if not text or not len(self.automaton):
            return
        low = text.translate(_LOWER)
        near: list[tuple[int, int, int]] = []  # a heap: by place, longest first
        end: dict[int, int] = {}

        def settled(place: int) -> Iterator[tuple[int, int, int]]:
            """Matches that begin before ``place``, of which all wordings are known."""
            while near and near[0][0] < place:
                start, stop, i = heappop(near)
                stop = -stop
                if start < end.get(i, 0):
                    continue
                if i in self.tails:
                    more = self.tails[i].match(low, stop)
                    if not more:
                        continue
                    stop = more.end()
                end[i] = stop
                yield i, start, stop

        for last, (n, who) in self.automaton.iter(low):
            start, stop = last + 1 - n, last + 1
            yield from settled(stop - self.longest)
            before = start > 0 and _word(low[start - 1])
            after = stop < len(low) and _word(low[stop])
            if before != _word(low[start]) and after != _word(low[last]):
                for i in who:
                    heappush(near, (start, -stop, i))
        yield from settled(len(low))

    def spans(self, text: str | None) -> dict[int, list[tuple[int, int]]]:
        """By the number of the concept the spans of its matches, in order."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, start, stop in self.found(text):
            out.setdefault(i, []).append((start, stop))
        return out


def _parts(concepts: Mapping[str, Sequence[str]]) -> Iterator[dict[str, list[str]]]:
    """Concepts in parts of about PART_CHARS; one concept is never split, as its matches exclude each other."""
    held, size = {}, 0
    for name, words in concepts.items():
        chars = sum(map(len, words))
        if held and size + chars > PART_CHARS:
            yield held
            held, size = {}, 0
        held[name] = list(words)
        size += chars
    if held:
        yield held


def _passes(df: DataFrame, text: str, concepts: Mapping[str, Sequence[str]], tails: Mapping[str, str] | None, run, schema) -> DataFrame:
    out = None
    for part in _parts(concepts):
        held = df.sparkSession.sparkContext.broadcast((part, {c: t for c, t in (tails or {}).items() if c in part}))
        one = df.mapInArrow(run(held), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no concepts")
    return out


def matches(df: DataFrame, text: str, concepts: Mapping[str, Sequence[str]], keep: Sequence[str], tails: Mapping[str, str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` with concept, start and stop (from 0, in code points) of every match."""
    slim = df.select(*keep, F.col(text).alias("_text"))
    out = slim.select(*keep).limit(0).withColumns({"concept": F.lit(""), "start": F.lit(0), "stop": F.lit(0)})
    schema = to_arrow_schema(out.schema)

    def run(held):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(*held.value)
            for batch in batches:
                kept = batch.select(list(keep))  # never the text, which would be copied for each of its matches
                at = ((i, *x) for i, t in enumerate(batch.column("_text")) for x in m.found(t.as_py()))
                while block := list(islice(at, BLOCK_ROWS)):
                    rows, which, start, stop = zip(*block)
                    taken = kept.take(pa.array(rows, pa.int64()))
                    made = {"concept": pa.array([m.names[c] for c in which], pa.string()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())}
                    yield pa.record_batch([(made[f.name] if f.name in made else taken.column(f.name)).cast(f.type) for f in schema], schema=schema)

        return task

    return _passes(slim, text, concepts, tails, run, out.schema)


def covered(df: DataFrame, text: str, concepts: Mapping[str, Sequence[str]], keep: Sequence[str], tails: Mapping[str, str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` with concept, hits and chars (code points that its matches cover), one row a text and concept; 0 without a match."""
    slim = df.select(*keep, F.col(text).alias("_text"))
    out = slim.select(*keep).limit(0).withColumns({"concept": F.lit(""), "hits": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")})
    schema = to_arrow_schema(out.schema)

    def run(held):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(*held.value)
            for batch in batches:
                kept = batch.select(list(keep))
                texts = enumerate(batch.column("_text"))
                while some := list(islice(texts, max(1, BLOCK_ROWS // len(m.names)))):
                    rows, which, count, chars = [], [], [], []
                    for i, t in some:
                        n, size = [0] * len(m.names), [0] * len(m.names)
                        for c, start, stop in m.found(t.as_py()):
                            n[c] += 1
                            size[c] += stop - start
                        rows += [i] * len(n)
                        which += m.names
                        count += n
                        chars += size
                    taken = kept.take(pa.array(rows, pa.int64()))
                    made = {"concept": pa.array(which, pa.string()), "hits": pa.array(count, pa.int64()), "chars": pa.array(chars, pa.int64())}
                    yield pa.record_batch([(made[f.name] if f.name in made else taken.column(f.name)).cast(f.type) for f in schema], schema=schema)

        return task

    return _passes(slim, text, concepts, tails, run, out.schema)


def hits(df: DataFrame, text: str, concepts: Mapping[str, Sequence[str]], keys: Sequence[str], tails: Mapping[str, str] | None = None) -> DataFrame:
    """concept and hits, by ``keys``: all matches in all texts; a concept without a match in a group has 0."""
    slim = df.select(*keys, F.col(text).alias("_text"))
    out = slim.select(*keys).limit(0).withColumns({"concept": F.lit(""), "hits": F.lit(0).cast("long")})
    schema = to_arrow_schema(out.schema)

    def run(held):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(*held.value)
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in keys]
                count: dict[tuple, int] = {}
                groups = list(zip(*columns)) if keys else [()] * batch.num_rows
                for key, t in zip(groups, batch.column("_text").to_pylist()):
                    for c in range(len(m.names)):
                        count.setdefault((key, c), 0)
                    for c, spans in m.spans(t).items():
                        count[key, c] += len(spans)
                made = [list(x) for x in zip(*(k for k, _ in count))] if keys else []
                made += [[m.names[c] for _, c in count], list(count.values())]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(made, schema)] if count else [pa.array([], f.type) for f in schema], schema=schema)

        return task

    return _passes(slim, text, concepts, tails, run, out.schema).groupBy(*keys, "concept").agg(F.sum("hits").alias("hits"))


def concept_hits(df: DataFrame, text: str, concepts: Mapping[str, tuple[Sequence[str], Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """concept, full and bare by ``keys``: hits of a concept's full wordings and of those without its curated variants."""
    both = {f"{c}\0{kind}": words for c, pair in concepts.items() for kind, words in zip(("full", "bare"), pair)}
    by = hits(df, text, both, keys).withColumn("_k", F.split("concept", "\0"))
    side = lambda kind: F.sum(F.when(F.col("_k")[1] == kind, F.col("hits")).otherwise(0)).alias(kind)
    return by.groupBy(*keys, F.col("_k")[0].alias("concept")).agg(side("full"), side("bare"))
