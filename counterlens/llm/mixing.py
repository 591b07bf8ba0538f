"""Mixing sources to target weights along a curriculum that changes over training.

Sizes are words. Sources in code point order, null last, weigh 5, 2, 1, repeating, and
share ``share`` times all words; no source takes more than ``REPEATS`` times its size, the
excess being shared again by weight. As the targets are min(REPEATS * size, level *
weight) for one level, they follow from sorting sources by their size per weight.

Each source has a schedule, a weight over training time 0 to 1 given by knots. Its
integral, scaled to the target, is the source's cumulative demand. Documents of a source
line up in a fixed hashed order, once a repeat, and the demand is inverted at the middle
of each copy: that time is the copy's position, and ``training_order`` range-sorts copies
by it. A source's last copy may be taken in part, so its words meet the target to within
one.

A source may hold most rows: its running sums are taken in hash ranges whose totals are
summed beforehand, so no task holds a source. There are 4096 ranges a source, and sixteen
times as many whenever the table has more than ``RANGE_ROWS`` rows for each. Only DataFrame
operations are used.

Cases: null text has size 0, takes nothing and has no position. A null source is a source
of its own. Rows with equal ids are separate documents. Sources of size 0 have target 0.
An empty table gives an empty result. Columns other than doc_id, text and source are
ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
REPEATS = 2
#: Ranges are the first hexadecimal digits of a hash: at least three, and more as the table grows.
RANGE_DIGITS = (3, 6)
RANGE_ROWS = 1_000_000
#: Knots (time, weight) by source weight: the heavy start strong and fade, the light come late.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def invert(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """Time by which a schedule's integral reaches this share of the whole."""
    areas = [0.0]
    for (t, v), (u, w) in zip(knots, knots[1:]):
        areas.append(areas[-1] + (u - t) * (v + w) / 2)
    goal, out = share * F.lit(areas[-1]), None
    for k in reversed(range(len(knots) - 1)):
        (t, v), (u, w) = knots[k], knots[k + 1]
        left = goal - F.lit(areas[k])
        slope = (w - v) / (u - t)
        part = F.lit(t) + (left / F.lit(v) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(v * v) + left * F.lit(2 * slope))) - F.lit(v)) / F.lit(slope))
        out = part if out is None else F.when(goal <= F.lit(areas[k + 1]), part).otherwise(out)
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """source_key, weight, source_size, target of every source; sizes has source_key, source, size."""
    sums = sizes.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("long")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    rated = sums.withColumn("weight", weight).withColumn("cap", F.lit(REPEATS).cast("long") * F.col("source_size"))
    line = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = rated.withColumn("over", F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
    rated = rated.withColumn("heavy", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
    rated = rated.withColumn("all", F.sum("source_size").over(every))
    # hundredths of words that the sources from here on share
    rated = rated.withColumn("left", F.lit(SHARE_PERCENT) * F.col("all") - F.lit(100) * F.col("over"))
    rated = rated.withColumn("capped", big("left") * big("weight") > F.lit(100) * big("cap") * big("heavy"))
    free = rated.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap").cast("double") / F.col("weight"), F.col("left"), F.col("heavy")))).over(every))
    level = F.col("level.left").cast("double") / (F.lit(100) * F.col("level.heavy")).cast("double")
    return free.select("source_key", "weight", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight").cast("double")).alias("target"))


def plan(docs: DataFrame, scratch: Scratch, schedules: dict = SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: what the mix takes of it in each repeat, and when.

    Columns ``keep`` are carried along and decide the order of rows that are equal otherwise.

    Columns doc_id, size, source_size, target, taken, takes (array), positions (array, null
    where nothing is taken) and position, the first of them.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    slim = docs.select("doc_id", *keep, "source", size.alias("size"), key.alias("source_key"), order.alias("place"))
    slim = scratch.table(slim, "sizes")
    digits, rows = RANGE_DIGITS[0], slim.count()
    while digits < RANGE_DIGITS[1] and rows > RANGE_ROWS * 16**digits:
        digits += 1
    slim = slim.withColumn("range", F.substring("place", 1, digits))
    parts = slim.groupBy("source_key", "range").agg(F.sum("size").alias("part"))
    ahead = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_key", "range", F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("ahead"))
    whole = parts.join(targets(slim), "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy("place", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(whole, ["source_key", "range"])
    placed = placed.withColumn("at", F.col("ahead") + F.col("inside")).withColumn("wanted", F.floor("target"))
    takes, times = [], []
    for k in range(REPEATS):
        begin = F.col("at") + F.lit(k) * F.col("source_size")
        take = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("wanted") - begin))
        share = (begin.cast("double") + take.cast("double") / F.lit(2.0)) / F.col("wanted").cast("double")
        time = None
        for weight, knots in schedules.items():
            time = F.when(F.col("weight") == weight, invert(knots, share)) if time is None else time.when(F.col("weight") == weight, invert(knots, share))
        takes.append(take)
        times.append(F.when(take > 0, time))
    out = placed.select("doc_id", *keep, "size", "source_size", "target", F.array(*takes).alias("takes"), F.array(*times).alias("positions"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumns({"taken": taken, "position": F.element_at("positions", 1)})


def training_copies(planned: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row a copy: doc_id, size, take, position, repeat."""
    copy = F.explode(F.arrays_zip(F.col("takes").alias("take"), F.col("positions").alias("position"), F.sequence(F.lit(1), F.lit(REPEATS)).alias("repeat")))
    return planned.select("doc_id", *keep, "size", copy.alias("c")).select("doc_id", *keep, "size", "c.*").where("take > 0")


def training_order(planned: DataFrame) -> DataFrame:
    """Copies, range-sorted by position."""
    return training_copies(planned).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "mix"))
    out = planned.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over,
         sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
         sum(source_size) OVER () AS total FROM s
), c AS (
  SELECT *, 150 * total - 100 * over AS remains, (150 * total - 100 * over) * weight > 100 * cap * heavy AS capped FROM r
), l AS (
  SELECT arg_min(CAST(remains AS DOUBLE) / CAST(100 * heavy AS DOUBLE), CAST(cap AS DOUBLE) / weight) AS level FROM c WHERE NOT capped
), t AS (
  SELECT source, source_size, weight, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE level * CAST(weight AS DOUBLE) END AS target FROM c LEFT JOIN l ON TRUE
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.weight, t.target, CAST(floor(t.target) AS BIGINT) AS wanted,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, wanted - begin_at)) AS t1, greatest(0, least(size, wanted - begin_at - source_size)) AS t2 FROM p
), u AS (
  SELECT *, CASE WHEN t1 > 0 THEN (CAST(begin_at AS DOUBLE) + CAST(t1 AS DOUBLE) / 2.0) / CAST(wanted AS DOUBLE) END AS share FROM q
)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
       round(CASE WHEN share IS NULL THEN NULL WHEN weight = 5 THEN (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + share * 1.0 * (-2.0))) - 1.5) / (-1.0)
                  WHEN weight = 2 THEN share
                         ELSE CASE WHEN share <= 0.375 THEN (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + share * 2.0)) - 0.5) / 1.0
                                   ELSE 0.5 + (sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE + (share - 0.375) * 2.0)) - 1.0) / 1.0 END END, 9) AS position
FROM u
"""
