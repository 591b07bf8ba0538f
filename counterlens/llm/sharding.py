"""Balanced shards by label propagation, with DataFrame operations only.

Documents are linked if their texts are equal. A group of equal texts is a star around
its text, so a shard's pull on a document is the number of the group's members there;
no pair of members is listed. A group of more than half a shard's rows is split by hash
into parts of about that size, as no shard could hold it.

A round joins every linked document with its group's counts by shard and lets it move to
the shard that holds most of its group. Moves obey quotas: a shard takes groups with the
probability (decided by a hash of group and round) that its free room is of the wanted
moves. After ``ROUNDS`` rounds, or once nothing wants to move, the law ``rows`` is made
exact. A shard keeps stars that it holds whole, in the order of a hash, as far as its
share of documents reaches; the other stars, each in one run, and then the documents
without a link fill the shares that have room. So a star is cut only where one shard's
room ends, which happens to fewer stars than there are shards. Shard sizes differ by one
row at most.

Places of pieces are running sums in hash ranges with totals summed beforehand, and
places inside a large piece are taken in hash ranges too, so no task holds a shard or a
group. Keys that hold more than one row in ``HOT`` are joined by broadcast (there are at
most ``HOT`` of them), the others by a shuffle in which none is that large.

Cases: null text counts no bytes, has crc32 0 and is linked with nothing; empty texts
are equal to each other. Rows with equal ids are separate documents. With fewer
documents than shards, the first shards get one each. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.shared import HOT, Scratch, with_each

SHARDS = 24
ROUNDS = 4
RANGES = 64
RANGE_ROWS = 1_000_000
SCALE = 1 << 30
ROW = ["doc_id", "size", "text_crc32"]


def _starts(pieces: DataFrame, keys: list[str], order: list[str], ranges: int, of: str | None = None) -> DataFrame:
    """``pieces`` with start: the sum of n before each piece of a key, in the order of (range, *order). Pieces of one ``of`` share a range."""
    ranged = pieces.withColumn("_range", F.pmod(F.xxhash64(*([of] if of else order)), F.lit(ranges)))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    out = ranged.withColumn("_inside", inside).join(sums, [*keys, "_range"])
    return out.withColumn("start", (F.col("_ahead") + F.col("_inside")).cast("long")).drop("_range", "_ahead", "_inside")


def _places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with place: 0, 1, ... inside each value of ``keys``, of which column n says how many rows it has."""
    ranged = rows.withColumn("_range", F.pmod(F.xxhash64(*ROW), F.ceil(F.col("n") / F.lit(RANGE_ROWS))))
    counts = ranged.where(F.col("n") > RANGE_ROWS).groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_range", F.sum("_n").over(ahead).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*ROW)) - 1
    out = ranged.withColumn("_inside", inside).join(counts, [*keys, "_range"], "left")
    return out.withColumn("place", (F.coalesce("_ahead", F.lit(0)) + F.col("_inside")).cast("long")).drop("_range", "_ahead", "_inside")


def _choose(value: Column, options: list) -> Column:
    """options[value]"""
    return F.element_at(F.array(*map(F.lit, options)), (value + 1).cast("int"))


def shard(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    raw = F.col("text").cast("binary")
    facts = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"),
    )
    facts = scratch.table(facts, "facts")
    total = facts.count()
    room = -(-total // shards)
    part_rows = max(2, room // 2)
    ranges = max(RANGES, total // RANGE_ROWS)

    # linked documents: groups of at least two, large ones in parts
    text = ["text_hash", "text_crc32", "size"]
    groups = facts.where("text_hash IS NOT NULL").groupBy(*text).agg(F.count("*").alias("members")).where("members > 1")
    known = with_each(facts, scratch.table(groups, "groups"), text, "members", total, HOT)
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    piece = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("members") / F.lit(part_rows)))
    star = F.when(F.col("members").isNotNull(), F.xxhash64(*text, piece))
    placed = scratch.table(known.select(*ROW, star.alias("star"), start.alias("shard")), "placed")
    state = placed.where("star IS NOT NULL")
    for k in range(1, rounds + 1):
        cells = state.groupBy("star", "shard").agg(F.count("*").alias("n"))
        # most members first, then by a hash, so that ties do not all favour one shard
        pull = F.max(F.struct("n", F.xxhash64("star", "shard"), "shard"))
        wants = cells.groupBy("star").agg(pull.alias("best"), F.sum("n").alias("all"))
        wants = wants.select("star", F.col("best.shard").alias("goal"), (F.col("all") - F.col("best.n")).alias("moving"), F.col("best.n").alias("staying"))
        wants = scratch.table(wants, f"wants-{k}")
        asked = {r["goal"]: (r["moving"], r["staying"]) for r in wants.groupBy("goal").agg(F.sum("moving").alias("moving"), F.sum("staying").alias("staying")).collect()}
        if not sum(m for m, _ in asked.values()):
            break
        chances = []
        for i in range(shards):
            moving, staying = asked.get(i, (0, 0))
            chances.append(min(SCALE, max(0, room - staying) * SCALE // moving) if moving else SCALE)
        allowed = F.pmod(F.xxhash64("star", F.lit(k)), F.lit(SCALE)) < _choose(F.col("goal"), chances)
        goals = wants.where("moving > 0").select("star", F.when(allowed, F.col("goal")).alias("goal"), (F.col("moving") + F.col("staying")).alias("rows"))
        moved = with_each(state, goals, ["star"], "rows", total, HOT)
        state = scratch.table(moved.select(*ROW, "star", F.coalesce("goal", "shard").alias("shard")), f"state-{k}")
        if k > 1:
            scratch.drop(f"state-{k - 1}")

    # the law: shard i holds total // shards rows, one more where i < total % shards
    share = [total // shards + (i < total % shards) for i in range(shards)]
    pieces = state.groupBy("shard", "star").agg(F.count("*").alias("n"))
    pieces = scratch.table(pieces.withColumn("shards", F.count("*").over(Window.partitionBy("star"))), "pieces")
    whole = scratch.table(_starts(pieces.where("shards = 1"), ["shard"], ["star"], ranges), "whole")
    fits = F.col("start") + F.col("n") <= _choose(F.col("shard"), share)
    held = {r["shard"]: r["n"] for r in whole.where(fits).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # pieces that found no room, and those of a star in several shards, come first in the pool, star by star
    loose = pieces.where("shards > 1").drop("shards").unionByName(whole.where(~fits).select("shard", "star", "n"))
    loose = _starts(loose.withColumn("pool", F.lit(0)), ["pool"], ["star", "shard"], ranges, of="star").drop("pool")
    settled = whole.where(fits).select("shard", "star", "n", "start", F.lit(True).alias("fits"))
    settled = scratch.table(settled.unionByName(loose.select("shard", "star", "n", "start", F.lit(False).alias("fits"))), "settled")
    linked = _places(with_each(state, settled, ["shard", "star"], "n", total, HOT), ["shard", "star"])
    linked = scratch.table(linked.select(*ROW, "shard", "fits", (F.col("start") + F.col("place")).alias("slot")), "linked")
    n_loose = state.count() - sum(held.values())
    alone = placed.where("star IS NULL").select(*ROW).withColumns({"n": F.lit(1).cast("long"), "_tie": F.monotonically_increasing_id()})
    alone = _starts(alone.withColumn("pool", F.lit(0)), ["pool"], [*ROW, "_tie"], ranges)
    pool = linked.where("NOT fits").select(*ROW, "slot").unionByName(alone.select(*ROW, (F.col("start") + n_loose).alias("slot")))
    ends, begins, at = [], [], 0
    for i in range(shards):
        begins.append(at)
        at += share[i] - held.get(i, 0)
        ends.append(at)
    goal = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("slot"))).cast("int")
    filled = pool.withColumn("shard", goal)
    filled = filled.withColumn("slot", (F.col("slot") - _choose(goal, begins) + _choose(goal, [held.get(i, 0) for i in range(shards)])).cast("long"))
    out = linked.where("fits").select(*ROW, "shard", "slot").unionByName(filled.select(*ROW, "shard", "slot"))
    return out.select(*ROW, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "shards"))
