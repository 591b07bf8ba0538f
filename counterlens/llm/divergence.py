"""How the sources of a language differ in their terms.

A term is a run of letters A-Z, a-z and code points above 0x7F, with A-Z lower-cased. A
language keeps the terms found in at least ``min_docs`` of its documents (rows). Each
source of a language, and the language as a whole, gives a kept term the share
p = 1 + floor(10^9 (n + 1) / (N + V)): n are its occurrences there, N those of all kept
terms, V is the number of kept terms. Two shares are f = floor((p - q)^2 / q) apart.

Method: terms are counted by DuckDB in chunks of text where the documents lie, and the
counts are hashed to shards by language and term. A shard's rows stream through DuckDB,
which merges them and keeps the frequent terms. In a second pass each shard gives, again by
vectorised SQL, partial sums for pairs of sources, how many terms have which share, and its
first terms of each source; Spark adds the sums and merges the rankings.

A pair's sum over all terms of the language is built from the terms that are there. With
p0 for the share of an absent term, and a and b the two sources,

    sum f(pa, pb) = V f(pa0, pb0)
                  + sum over terms of a          f(pa, pb0) - f(pa0, pb0)
                  + sum over terms of b          f(pa0, pb) - f(pa0, pb0)
                  + sum over terms of both       f(pa, pb) - f(pa, pb0) - f(pa0, pb) + f(pa0, pb0)

The first three need only how many terms have which share; the last is a shard's join of
its own terms. All arithmetic is on integers (128 bits where 64 could overflow).

A term found everywhere is many rows of one shard, but they are merged as they come, and
the largest are merged before they are sent. A group that holds a third of all rows costs no
task more than others: nothing is dealt by group before its sums and first terms are small.

Cases: null text, language or source counts as the empty string. Rows that share an id, or
are equal, are documents of their own. A source without terms, or a language without kept
terms, is listed with its pairs (value 0 if nothing is kept) and without terms. Ties rank by
item, by UTF-8. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from counterlens.llm import kernel as K
from counterlens.llm.shared import Scratch, with_each

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
MIN_DOCS = 3
TOP = 200
CHUNK = 8 << 20
HELD_ROWS = 400_000
LEAST_SHARDS = 64
SHARD_BYTES = 128 << 20
SHARD_ROWS = 500_000

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, source string, n long, first long"
PARTS = "part string, lang string, source string, item string, p long, p0 long, value decimal(38,0)"

_COUNT = f"""
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (
  SELECT row, lang, source, term, count(*) AS n FROM (
    SELECT row, lang, source, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
    FROM docs) GROUP BY ALL) GROUP BY ALL"""

_MERGE = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"

_FREQUENT = f"""
SELECT lang, term, source, n, CASE WHEN source = min(source) OVER w THEN 1 ELSE 0 END AS first FROM ({_MERGE})
WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= """

#: f of two shares; both are at most 10^9 + 1, so the square fits 64 bits.
_APART = "(({a} - {b}) * ({a} - {b}) // {b})"

_SHARES = f"""
CREATE OR REPLACE TEMP TABLE shares AS SELECT *,
  CAST(1 + CAST({UNIT} AS HUGEINT) * (n + 1) // (total + terms) AS BIGINT) AS p,
  CAST(1 + CAST({UNIT} AS HUGEINT) // (total + terms) AS BIGINT) AS p0,
  CAST(1 + CAST({UNIT} AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + 1) // (lang_total + terms) AS BIGINT) AS q
FROM kept"""


def _partial(top: int) -> str:
    f = lambda a, b: _APART.format(a=a, b=b)
    both = f"{f('a.p', 'b.p')} - {f('a.p', 'b.p0')} - {f('a.p0', 'b.p')} + {f('a.p0', 'b.p0')}"
    return f"""
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS p0, CAST(sum({both}) AS DECIMAL(38,0)) AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL
SELECT 'share', lang, source, NULL, p, p0, CAST(count(*) AS DECIMAL(38,0)) FROM shares GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, p, p0, CAST(value AS DECIMAL(38,0)) FROM (SELECT *, {f('p', 'q')} AS value FROM shares WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}"""


class _Engine:
    """DuckDB in memory, on the one core of a task."""

    def __init__(self):
        K.enter("divergence")
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def table(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.con.register(name, table)
        out = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return out


def _sent(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=20_000)


def _count(schema: pa.Schema):
    """Task side of the first pass: counts of terms by group, merged over chunks as long as that makes them fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, held, waiting, size = _Engine(), [], [], 0

        def counted() -> pa.Table:
            docs = pa.Table.from_batches(waiting)
            return engine.table(_COUNT, docs=docs.append_column("row", pa.array(range(docs.num_rows), pa.int64())))

        def take() -> Iterator[pa.RecordBatch]:
            held.append(counted())
            waiting.clear()
            if sum(t.num_rows for t in held) >= HELD_ROWS:
                merged = engine.table(_MERGE, counts=pa.concat_tables(held))
                held[:] = [merged]
                if merged.num_rows >= HELD_ROWS // 2:
                    held.clear()
                    yield from _sent(merged, schema)

        for part in K.chunks(batches, "text", CHUNK):
            waiting.append(part)
            size += part.column("text").nbytes
            if size >= CHUNK:
                size = 0
                yield from take()
        if waiting:
            yield from take()
        if held:
            yield from _sent(engine.table(_MERGE, counts=pa.concat_tables(held)), schema)

    return run


def _frequent(schema: pa.Schema, min_docs: int):
    """A shard's counts, merged as they come, and its frequent terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, held, rows, merged = _Engine(), [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= HELD_ROWS + 2 * merged:  # a constant number of passes over each row
                held = [engine.table(_MERGE, counts=pa.concat_tables(held))]
                rows = merged = held[0].num_rows
        if held:
            yield from _sent(engine.table(_FREQUENT + str(min_docs), counts=pa.concat_tables(held)), schema)

    return run


def _parts(schema: pa.Schema, top: int):
    """A shard's partial sums, counts of shares and first terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            engine = _Engine()
            engine.con.register("kept", pa.Table.from_batches(held))
            engine.con.execute(_SHARES)
            yield from _sent(engine.table(_partial(top)), schema)

    return run


def _apart(a: str, b: str) -> F.Column:
    return F.expr(f"(({a} - {b}) * ({a} - {b})) div {b}")


def _times(count: F.Column, value: F.Column) -> F.Column:
    return (count.cast("decimal(19,0)") * value.cast("decimal(19,0)")).cast("decimal(38,0)")


def audit(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank from (text, lang, source).

    Part ``pair``: each other source of the language, and the sum of f over all kept terms
    with the other's shares as q. Part ``term``: the first ``top`` terms that the source uses
    more than its language does, with the language's share as q.
    """
    whole = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    seen = scratch.table(whole.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "seen")
    shards = lambda n, each: max(LEAST_SHARDS, math.ceil((n or 0) / each))

    counted = whole.mapInArrow(_count(_schema(docs, COUNTS)), COUNTS)
    dealt = counted.repartition(shards(seen.agg(F.sum("bytes")).first()[0], SHARD_BYTES), "lang", "term")
    kept = scratch.table(dealt.mapInArrow(_frequent(_schema(docs, KEPT), min_docs), KEPT), "kept")

    by_group = scratch.table(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("terms"), F.count("*").alias("rows")), "by_group")
    by_lang = by_group.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"))
    groups = seen.select("lang", "source").join(by_group.drop("terms"), ["lang", "source"], "left").join(by_lang, "lang", "left")
    p0 = F.expr(f"CASE WHEN terms > 0 THEN 1 + {UNIT} div (total + terms) END")
    groups = scratch.table(groups.fillna(0, ["total", "rows", "lang_total", "terms"]).withColumn("p0", p0), "groups")

    n_kept = kept.count()
    named = with_each(kept.drop("first"), groups.drop("p0"), ["lang", "source"], "rows", n_kept).drop("rows")
    parts = scratch.table(named.repartition(shards(n_kept, SHARD_ROWS), "lang", "term").mapInArrow(_parts(_schema(docs, PARTS), top), PARTS), "parts")

    key = ["lang", "source", "item"]
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    facing = lambda df: df.join(others, "lang").where("source <> item")
    none = facing(groups).select(*key, F.coalesce(_times(F.col("terms"), _apart("p0", "q0")), F.lit(0).cast("decimal(38,0)")).alias("value"))
    shares = parts.where("part = 'share'").groupBy("lang", "source", "p", "p0").agg(F.sum("value").alias("terms"))
    one = facing(shares)
    there = one.select(*key, _times(F.col("terms"), _apart("p", "q0") - _apart("p0", "q0")).alias("value"))
    turned = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), _times(F.col("terms"), _apart("q0", "p") - _apart("q0", "p0")).alias("value"))
    both = parts.where("part = 'pair'").select(*key, "value")
    sums = none.unionByName(there).unionByName(turned).unionByName(both).groupBy(*key).agg(F.sum("value").cast("long").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(*order))).where(F.col("rank") <= top)
    # shards' lists meet in two steps, so that no task holds all lists of one source
    some = F.pmod(F.xxhash64("item"), F.lit(math.isqrt(shards(n_kept, SHARD_ROWS)))).cast("int")
    terms = first(first(terms.withColumn("some", some), "some").drop("some", "rank"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _schema(docs: DataFrame, ddl: str) -> pa.Schema:
    return to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "divergence"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), o AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT *, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS BIGINT) AS q
  FROM full_counts JOIN v USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source AND sums.item = h.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
