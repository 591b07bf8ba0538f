"""Nearest neighbours on a line and in time, intervals, and matched controls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from counterlens.operators.ordered import running
from counterlens.operators.sampling import text_draw


def nearest_levels(levels: DataFrame, value: str, rows: str, k: int) -> DataFrame:
    """(value, other, below): the neighbouring values, on both sides of each value, that ``k`` rows a side can come from.

    ``levels`` has one row a value, with in ``rows`` how many rows it stands for. Values are
    placed on the line by running sums in ranges; a value and its neighbours meet by place,
    so the work is values times k and no task holds the line.
    """
    capped = levels.withColumn("_c", F.least(F.col(rows), F.lit(k)).cast("long"))
    one = capped.withColumn("_one", F.lit(1).cast("long"))
    placed = running(one, [], [value], {"_place": "_one"}).select(value, "_place")
    step = placed.withColumn("_step", F.explode(F.array(*[F.lit(s).cast("long") for s in range(-k, k + 1) if s]))).withColumn("_at", F.col("_place") + F.col("_step"))
    other = placed.join(capped.select(value, "_c"), value).select(F.col(value).alias("other"), F.col("_place").alias("_at"), "_c")
    met = step.join(other, "_at").withColumn("below", F.col("_step") < 0)
    # a side's farther values do not matter once the nearer ones hold k rows
    nearer = Window.partitionBy(value, "below").orderBy(F.abs("_step")).rowsBetween(Window.unboundedPreceding, -1)
    return met.where(F.abs("_step") <= k).withColumn("_held", F.coalesce(F.sum("_c").over(nearer), F.lit(0))).where(F.col("_held") < k).select(value, "other", "below")


def matched_controls(features: DataFrame, name: str = "feature", n: str = "n", pool: int = 50, draws: int = 5, seed: str = "0") -> DataFrame:
    """feature, control, place, log_ratio, drawn: each live feature's ``pool`` nearest others, and which of them are drawn as its controls.

    Features are near whose counts are near in ln(n + 1). There is no band, so a feature of
    any count has min(pool, live - 1) controls, and log_ratio tells how good a match is.
    Dead features (n = 0) have none and are none. Of equally near ones the first by name
    come first. ``draws`` of the pool are drawn by a hash of seed, feature and control.

    Features of one count share one pool, found from the first names of the counts next to
    it on both sides; work is features times pool.
    """
    live = features.where(F.col(n) > 0).select(F.col(name).alias("feature"), F.col(n).cast("long").alias("n"))
    level = live.groupBy("n").agg(F.count("*").alias("rows"))
    # more than pool + 1 features of one count are never asked for: one may be the feature itself
    first = live.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("feature"))).where(F.col("_r") <= pool + 1).select(F.col("n").alias("other"), F.col("feature").alias("control"))
    around = nearest_levels(level, "n", "rows", pool).select("n", "other").unionByName(level.select("n", F.col("n").alias("other")))
    gap = F.round(F.abs(F.ln(F.col("other") + 1.0) - F.ln(F.col("n") + 1.0)), 12)
    near = around.join(first, "other").withColumn("log_ratio", gap)
    place = F.row_number().over(Window.partitionBy("n").orderBy("log_ratio", "control"))
    pools = near.withColumn("_p", place).where(F.col("_p") <= pool + 1).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("log_ratio", "control"))).alias("_pool"))
    own = F.slice(F.filter("_pool", lambda c: c["control"] != F.col("feature")), 1, pool)
    drawn = lambda c: F.struct(text_draw(F.concat_ws("|", F.lit(seed), "feature", c["control"])).alias("h"), c["control"].alias("control"))
    chosen = F.transform(F.slice(F.array_sort(F.transform("_own", drawn)), 1, draws), lambda d: d["control"])
    each = live.join(pools, "n").withColumn("_own", own).withColumn("_chosen", chosen)
    out = each.select("feature", "_chosen", F.posexplode("_own").alias("place", "_c"))
    return out.select("feature", F.col("_c.control").alias("control"), (F.col("place") + 1).alias("place"), F.col("_c.log_ratio").alias("log_ratio"), F.array_contains("_chosen", F.col("_c.control")).alias("drawn"))


def match_quality(controls: DataFrame) -> DataFrame:
    """feature, controls (drawn, in order of nearness) and worst_log_ratio: 0 is a perfect match, a large one says that nothing comparable exists."""
    drawn = controls.where("drawn").groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("place", "control"))).alias("_c"), F.max("log_ratio").alias("worst_log_ratio"))
    return drawn.select("feature", F.transform("_c", lambda c: c["control"]).alias("controls"), "worst_log_ratio")


DAY = 86_400
SLOT_DAYS = 28
GROUP_ROWS = 200_000


def _span_best(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest of order[lo:hi] of each pair of places; len(order) where that is empty."""
    ladder = [order]
    while 2 << (len(ladder) - 1) <= len(order):
        step = 1 << (len(ladder) - 1)
        ladder.append(np.minimum(ladder[-1][:-step], ladder[-1][step:]))
    out = np.full(len(lo), len(order))
    some = np.flatnonzero(hi > lo)
    width = np.frexp((hi - lo)[some].astype(float))[1] - 1
    for k in np.unique(width):
        at = some[width == k]
        out[at] = np.minimum(ladder[k][lo[at]], ladder[k][hi[at] - (1 << k)])
    return out


def _nearest(days: int, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        keys, code = np.unique(np.array(left["key"].to_pylist() + right["key"].to_pylist(), object).astype(str), return_inverse=True)
        ask, have = code[: left.num_rows], code[left.num_rows :]
        # ids as places in their own order, so that the smallest of a span can be told
        names = right["id"].combine_chunks()
        place = np.empty(right.num_rows, np.int64)
        by_id = pc.sort_indices(names).to_numpy()
        place[by_id] = np.arange(len(by_id))
        seconds = right["at"].to_numpy()
        base = min(seconds.min(), left["at"].to_numpy().min()) - (days + 2) * DAY
        reach = max(seconds.max(), left["at"].to_numpy().max()) + (days + 2) * DAY - base
        line = have * reach + (seconds - base)
        order = np.argsort(line, kind="stable")
        line, place = line[order], place[order]
        at = ask * reach + (left["at"].to_numpy() - base)
        best, gap = np.full(len(at), len(place)), np.full(len(at), -1)
        for g in range(days + 1):
            left_ = np.flatnonzero(gap < 0)
            for first in {g, -g}:  # whole days, rounded down: first <= (t - t0) / day < first + 1
                lo, hi = (np.searchsorted(line, at[left_] + d * DAY) for d in (first, first + 1))
                best[left_] = np.minimum(best[left_], _span_best(place, lo, hi))
            gap[left_[best[left_] < len(place)]] = g
        found = np.flatnonzero(gap >= 0)
        return pa.table([left["left"].take(pa.array(found)), names.take(pa.array(by_id[best[found]])), pa.array(gap[found], pa.int64())], schema=schema)

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_id: str, left_time: str, right_id: str, right_time: str, days: int) -> DataFrame:
    """left_id, right_id, gap: of the right rows of a left row's key within ``days`` days the nearest; left rows without any are left out.

    The gap is the size of the whole days between them, rounded down, so one second earlier
    is a day; of equal gaps the smallest right id. ``left_id`` should be unique. Rows with a
    NULL key or time match nothing. Pass only usable right rows to fall back on the next.

    Rows are dealt by key and by slots of ``SLOT_DAYS`` (or ``days``, if more). A right row
    near the edge of a slot is carried into the next one as well. So a key with very many
    rows is spread over its time, and a task holds slots of about ``GROUP_ROWS`` rows, each
    searched in sorted arrays: no pair of rows is made but the nearest.
    """
    slot = DAY * max(SLOT_DAYS, days + 1)
    l_ = left.select(F.col(left_id).alias("left"), F.col(key).alias("key"), F.unix_timestamp(left_time).alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
    r_ = right.select(F.col(right_id).alias("id"), F.col(key).alias("key"), F.unix_timestamp(right_time).alias("at")).where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL")
    groups = max(1, l_.count() // GROUP_ROWS, r_.count() // GROUP_ROWS)
    at = lambda shift: F.floor((F.col("at") + F.lit(shift * (days + 1) * DAY)) / F.lit(slot))
    dealt = lambda df, slots: df.withColumn("slot", slots).withColumn("group", F.pmod(F.xxhash64("key", "slot"), F.lit(groups)))
    # keys of both sides are told apart by slot, as a carried row may meet others of its key in a group
    own = lambda df: df.withColumn("key", F.concat_ws("|", F.col("key").cast("string"), F.col("slot").cast("string"))).drop("slot")
    asks = own(dealt(l_, at(0)))
    carried = own(dealt(r_, F.explode(F.array_distinct(F.array(at(-1), at(0), at(1))))))
    out = left.select(F.col(left_id)).schema.add(right.select(right_id).schema[0]).add("gap", "long")
    return asks.groupBy("group").cogroup(carried.groupBy("group")).applyInArrow(_nearest(days, to_arrow_schema(out)), out)


def overlapping(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Tokens (key, s, e) with each span (key, a, b) of their document that they overlap; empty ones overlap nothing.

    An interval of length up to 2**k lies in two bins of that size at most. A token and a
    span meet in bins of the longer one's size, where at least every second of its
    neighbours overlaps it; so work follows the result, also in one very long document.
    """
    level = lambda lo, hi: F.ceil(F.log2((F.col(hi) - F.col(lo)).cast("double"))).cast("int")
    t = tokens.where("e > s").withColumn("_lt", level("s", "e"))
    p = spans.where("b > a").withColumn("_lp", level("a", "b"))
    # at most 64 sizes of each
    sizes = {c: sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((t, "_lt"), (p, "_lp"))}
    at = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_level"))).cast("long")

    def binned(df: DataFrame, lo: str, hi: str, own: str, others: list[int] | None) -> DataFrame:
        levels = F.array(F.col(own)) if others is None else F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > F.col(own) if own == "_lp" else x >= F.col(own))
        at_level = df.withColumn("_level", F.explode(levels))
        return at_level.withColumn("_bin", F.explode(F.sequence(at(F.col(lo)), at(F.col(hi) - 1))))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.drop("_lt").join(b.drop("_lp"), [key, "_level", "_bin"])
        # of the bins that both lie in, the first tells
        return both.where((F.col("e") > F.col("a")) & (F.col("s") < F.col("b")) & (F.col("_bin") == at(F.greatest("a", "s")))).drop("_level", "_bin")

    short = met(binned(t, "s", "e", "_lt", sizes["_lp"]), binned(p, "a", "b", "_lp", None)) if sizes["_lp"] else None
    if short is None:
        return tokens.join(spans, key).limit(0)
    return short.unionByName(met(binned(t, "s", "e", "_lt", None), binned(p, "a", "b", "_lp", sizes["_lt"]))) if sizes["_lt"] else short
