"""Tables of interventions: effects by layer and dose against their controls, steering sweeps, pointing, edited tokens.

Every effect is judged against a control arm of its own. Effects keep their sign: an excess
is a difference of means, so +1 and -1 against a control of 0 are no excess.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_effects(effects: DataFrame, keys: Sequence[str], pair: str = "pair_id", raw: str = "delta", control: str = "control", gap: str = "gap", min_gap: float = 0.1) -> DataFrame:
    """ace and control (means), excess (ace - control), and normalised: ace over the gap.

    ``gap`` is what a pair's arms lie apart without any intervention; its mean is over pairs,
    and nothing is normalised where that mean is smaller than ``min_gap`` in size, as it
    would divide by noise.
    """
    apart = effects.groupBy(pair).agg(F.max(gap).alias("_gap")).agg(F.avg("_gap").alias("_gap"))
    by = effects.groupBy(*keys).agg(F.avg(raw).alias("ace"), F.avg(control).alias("control"))
    scaled = F.when(F.abs("_gap") >= min_gap, F.col("ace") / F.col("_gap"))
    # one row
    return by.crossJoin(F.broadcast(apart)).select(*keys, "ace", "control", (F.col("ace") - F.col("control")).alias("excess"), scaled.alias("normalised"))


def dose_table(effects: DataFrame, keys: Sequence[str], dose: str, raw: str = "delta", control: str = "control", shuffled: str = "shuffled") -> DataFrame:
    """By dose: n, ace, the means of a random and a shuffled control, and the excess over the random one."""
    by = effects.groupBy(*keys, dose).agg(F.count(raw).alias("n"), F.avg(raw).alias("ace"), F.avg(control).alias("random_control"), F.avg(shuffled).alias("shuffled_control"))
    return by.withColumn("excess", F.col("ace") - F.col("random_control"))


def dose_response(table: DataFrame, keys: Sequence[str], dose: str) -> DataFrame:
    """Of a ``dose_table``: whether the effect only rises or only falls with the dose, and the dose of the largest excess by size (of equals the lowest)."""
    step = F.round(F.col("ace") - F.lag("ace").over(Window.partitionBy(*keys).orderBy(dose)), 12)
    best = F.min(F.struct((-F.round(F.abs("excess"), 12)).alias("s"), F.col(dose).alias("dose"), "excess"))
    one_way = F.coalesce(F.bool_and(F.col("_step") >= 0) | F.bool_and(F.col("_step") <= 0), F.lit(True))
    by = table.withColumn("_step", step).groupBy(*keys).agg(one_way.alias("monotone"), best.alias("_b"))
    return by.select(*keys, "monotone", F.col("_b.dose").alias(f"best_{dose}"), F.col("_b.excess").alias("best_excess"))


def sweep_cells(margins: DataFrame, keys: Sequence[str], dose: str, pair: str = "pair_id", label: str = "label") -> DataFrame:
    """acc, cc, acc_rand, cc_rand by cell of items (margin, margin_rand): SAFE is answered above 0, a pair counts if all its arms are right."""
    good = lambda m: ((F.col(m) > 0) == (F.col(label) == "SAFE")).cast("double")
    arms = margins.groupBy(*keys, dose, pair).agg(*[f(x).alias(n) for m, tag in (("margin", ""), ("margin_rand", "_rand")) for f, x, n in ((F.sum, good(m), f"_k{tag}"), (F.min, good(m), f"_all{tag}"))], F.count("*").alias("_n"))
    columns = [c for tag in ("", "_rand") for c in ((F.sum(f"_k{tag}") / F.sum("_n")).alias(f"acc{tag}"), F.avg(f"_all{tag}").alias(f"cc{tag}"))]
    return arms.groupBy(*keys, dose).agg(*columns)


def _gain() -> Column:
    return F.round(F.col("cc") - F.col("cc_rand"), 12)


def best_cell(cells: DataFrame, keys: Sequence[str], layer: str, dose: str) -> DataFrame:
    """The cell of largest gain (cc - cc_rand; of equals the lowest layer, then dose), and whether it is more than noise.

    control_swing is the largest excursion of the control arm anywhere, a scale of noise
    from the same data. dose_response asks that the neighbours of the best cell gain at
    least half as much: those at its layer, of the same sign of the dose, by size. A lone
    cell, or the one without a dose, shows none. base is cc without a dose.
    """
    sized = cells.withColumn("gain", _gain())
    arm = Window.partitionBy(*keys, layer, F.signum(dose)).orderBy(F.abs(dose))
    sized = sized.withColumns({"before": F.lag("gain").over(arm), "after": F.lead("gain").over(arm)})
    first = lambda order, *cols: F.min(F.struct(*order, *cols))
    by = sized.groupBy(*keys).agg(
        first([(-F.col("gain")).alias("s"), F.col(layer).alias("layer"), F.col(dose).alias("dose")], "cc", "cc_rand", "gain", "before", "after").alias("_b"),
        F.min(F.when(F.col(dose) == 0, F.struct(layer, "cc"))).alias("_base"),
        F.max(F.abs("cc_rand")).alias("control_swing"),
        F.count("*").alias("cells"),
    )
    b = lambda c: F.col(f"_b.{c}")
    holds = lambda side: F.coalesce(b(side) >= 0.5 * b("gain"), F.lit(True))
    shown = (b("dose") != 0) & (b("before").isNotNull() | b("after").isNotNull()) & holds("before") & holds("after")
    return by.select(*keys, "cells", b("layer").alias(layer), b("dose").alias(dose), b("cc").alias("cc"), b("cc_rand").alias("cc_rand"), b("gain").alias("gain"), F.col("_base.cc").alias("base"), "control_swing", shown.alias("dose_response"))


def signed_arms(cells: DataFrame, keys: Sequence[str], layer: str, dose: str) -> DataFrame:
    """The best gain over control of all cells and of each sign of the dose: arm, cells, lowest and highest dose, where it is, and cc, cc_rand, gain there."""
    sign = F.when(F.col(dose) > 0, "positive").when(F.col(dose) < 0, "negative")
    each = cells.withColumn("gain", _gain()).withColumn("arm", F.explode(F.array_compact(F.array(F.lit("all"), sign))))
    best = F.min(F.struct((-F.col("gain")).alias("s"), F.col(layer).alias("layer"), F.col(dose).alias("dose"), "cc", "cc_rand", "gain"))
    by = each.groupBy(*keys, "arm").agg(F.count("*").alias("cells"), F.min(dose).alias("lowest"), F.max(dose).alias("highest"), best.alias("_b"))
    return by.select(*keys, "arm", "cells", "lowest", "highest", F.col("_b.layer").alias(layer), F.col("_b.dose").alias(dose), "_b.cc", "_b.cc_rand", "_b.gain")


def pointing(scores: DataFrame, items: DataFrame, decisive: DataFrame, present: DataFrame, expressible: DataFrame, item: str = "item") -> DataFrame:
    """How often an item's top concept is one that decides it: n, accuracy by sum and by mean, the same over expressible items, and a random guess.

    ``scores`` has (item, token, concept, x): what each candidate token gives a concept.
    ``items`` has (item, family), ``decisive`` (family, concept), ``present`` (item, concept)
    the concepts that an item's candidate tokens carry, ``expressible`` (concept) those that
    any feature stands for. An item counts if its family has a decisive concept and
    anything is present. Its top concept is the one with the largest sum (or mean over the
    tokens that score it) above 0; of equals the first by name; none if all are 0. The guess
    is the share of its present concepts that are decisive. An item none of whose decisive
    concepts can be expressed misses, and is also counted apart: that is a gap of the
    vocabulary, not of the attribution.
    """
    want = items.join(decisive, "family").select(item, "concept").distinct()
    can = want.join(expressible.select("concept").distinct().withColumn("_can", F.lit(1)), "concept", "left").groupBy(item).agg(F.max("_can").isNotNull().alias("_can"))
    there = present.select(item, "concept").distinct().join(want.withColumn("_wanted", F.lit(1)), [item, "concept"], "left")
    base = there.groupBy(item).agg((F.count("_wanted") / F.count("*")).alias("_guess"))
    tops = []
    for name, total in (("sum", F.sum("x")), ("mean", F.avg("x"))):
        by = scores.groupBy(item, "concept").agg(F.round(total, 12).alias("_t")).where("_t > 0")
        top = by.groupBy(item).agg(F.min(F.struct((-F.col("_t")).alias("s"), "concept")).alias("_b")).select(item, F.col("_b.concept").alias("concept"))
        tops.append(top.join(want, [item, "concept"]).select(item, F.lit(1.0).alias(f"_{name}")))
    rows = can.join(base, item)
    for top in tops:
        rows = rows.join(top, item, "left")
    hit = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("_can")).alias("n_inexpressible"),
        *[F.avg(hit(n)).alias(f"accuracy_{n}") for n in ("sum", "mean")],
        *[F.avg(F.when(F.col("_can"), hit(n))).alias(f"expressible_{n}") for n in ("sum", "mean")],
        F.avg("_guess").alias("random_accuracy"),
    )


def edited_percentile(tokens: DataFrame, pair: str = "pair_id", arm: str = "arm", arms: tuple[str, str] = ("safe", "unsafe")) -> DataFrame:
    """Of every pair that counts the percentile (0 to 1) that the tokens in which its arms differ have among the scores of the first arm.

    ``tokens`` has pair, arm, position, token, candidate and score. A pair counts if it has
    exactly these two arms, of equal length, with the same positions, and differs at a
    candidate position of the first arm. A position's percentile is its place among the
    arm's candidates by score (ties by position) over one less than their number; the
    pair's is the mean over the positions that differ.
    """
    keep = tokens.groupBy(pair).agg(F.array_sort(F.collect_set(arm)).alias("_arms"), F.count_if(F.col(arm) == arms[0]).alias("_a"), F.count_if(F.col(arm) == arms[1]).alias("_b"))
    keep = keep.where((F.col("_arms") == F.array(*map(F.lit, sorted(arms)))) & (F.col("_a") == F.col("_b"))).select(pair)
    side = lambda name: tokens.where(F.col(arm) == name)
    ranked = side(arms[0]).where("candidate").join(keep, pair)
    by = Window.partitionBy(pair)
    place = (F.row_number().over(by.orderBy("score", "position")) - 1) / F.greatest(F.lit(1), F.count("*").over(by) - 1)
    ranked = ranked.select(pair, "position", "token", place.alias("_p"))
    other = side(arms[1]).select(pair, "position", F.col("token").alias("_token"))
    differing = ranked.join(other, [pair, "position"]).where(F.col("token") != F.col("_token"))
    return differing.groupBy(pair).agg(F.avg("_p").alias("percentile"), F.count("*").alias("edited"))
