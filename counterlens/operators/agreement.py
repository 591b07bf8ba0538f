"""Agreement of raters over a long table of ratings: unit, rater, value.

A missing rating is NULL and takes no part. Units with one rating are left out, as they
pair with nothing. A unit's ratings are as few as its raters, so they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.operators.metrics import rate


def _units(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """unit, m ratings, and its (value, count) cells."""
    cells = ratings.where(F.col(value).isNotNull()).groupBy(unit, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return cells.groupBy(unit).agg(F.sum("n").alias("m"), F.collect_list(F.struct("value", "n")).alias("cells")).where("m >= 2")


def coincidences(ratings: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """x, y, o: how often two raters of one unit gave x and y, each unit weighing its number of ratings."""
    units = _units(ratings, unit, value).select("m", F.explode("cells").alias("a"), "cells").select("m", "a", F.explode("cells").alias("b"))
    same = F.when(F.col("a.value") == F.col("b.value"), 1).otherwise(0)
    o = (F.col("a.n") * (F.col("b.n") - same)).cast("double") / (F.col("m") - 1)
    return units.groupBy(F.col("a.value").alias("x"), F.col("b.value").alias("y")).agg(F.sum(o).alias("o"))


def krippendorff(ratings: DataFrame, unit: str = "unit", value: str = "value", level: str = "nominal") -> DataFrame:
    """alpha of nominal or ordinal ratings, by the textbook definition: agreements of different raters count.

    Tables of categories are crossed here; they are as small as the scale.
    """
    if level not in ("nominal", "ordinal"):
        raise ValueError(f"unknown level {level!r}")
    pairs = coincidences(ratings, unit, value)
    line = Window.orderBy("x")
    totals = pairs.groupBy("x").agg(F.sum("o").alias("n")).select("x", "n", F.sum("n").over(line).alias("c"))
    a, b = totals.select(*[F.col(c).alias(f"{c}_a") for c in totals.columns]), totals.select(*[F.col(c).alias(f"{c}_b") for c in totals.columns])
    gap = F.abs(F.col("c_b") - F.col("c_a")) - F.when(F.col("x_a") < F.col("x_b"), F.col("n_b") - F.col("n_a")).otherwise(F.col("n_a") - F.col("n_b")) / 2
    distance = F.when(F.col("x_a") == F.col("x_b"), 0.0).otherwise(F.lit(1.0) if level == "nominal" else gap * gap)
    crossed = a.crossJoin(b).withColumn("d", distance)
    scored = crossed.join(pairs, (F.col("x") == F.col("x_a")) & (F.col("y") == F.col("x_b")), "left")
    sums = scored.agg(F.sum(F.col("o") * F.col("d")).alias("seen"), F.sum(F.col("n_a") * F.col("n_b") * F.col("d")).alias("expected"), F.sum("o").alias("t"))
    return sums.select((F.lit(1.0) - F.try_divide((F.col("t") - 1) * F.col("seen"), F.col("expected"))).alias("alpha"))


def fleiss(ratings: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """kappa; units may have different numbers of ratings, two at least."""
    units = _units(ratings, unit, value)
    own = F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + x.n * (x.n - 1)).cast("double") / (F.col("m") * (F.col("m") - 1))
    seen = units.agg(F.avg(own).alias("seen"), F.sum("m").alias("t"))
    shares = units.select(F.inline("cells")).groupBy("value").agg(F.sum("n").alias("n"))
    chance = shares.crossJoin(F.broadcast(seen)).groupBy("seen").agg(F.sum(F.pow(F.col("n").cast("double") / F.col("t"), F.lit(2.0))).alias("chance"))
    return chance.select(F.try_divide(F.col("seen") - F.col("chance"), F.lit(1.0) - F.col("chance")).alias("kappa"))


def intra_rater(ratings: DataFrame, key: Column, keys: list[str], value: str = "value", mark: str = "R") -> DataFrame:
    """Agreement of ratings repeated under a key with ``mark`` at its end with those under the key itself."""
    named = ratings.withColumn("_key", key)
    repeat = F.col("_key").endswith(mark)
    base = F.when(repeat, F.expr(f"substr(_key, 1, length(_key) - {len(mark)})")).otherwise(F.col("_key"))
    first = named.where(F.col(value).isNotNull()).groupBy(*keys, base.alias("_base")).agg(F.max(F.when(~repeat, F.col(value))).alias("a"), F.max(F.when(repeat, F.col(value))).alias("b"))
    both = first.where("a IS NOT NULL AND b IS NOT NULL")
    return both.groupBy(*keys).agg(F.count("*").alias("repeats"), rate(F.col("a") == F.col("b")).alias("agreement"))


def pass_rate(ratings: DataFrame, feature: str, accepted: Column, trigger: float = 0.3) -> DataFrame:
    """Features, the share that at least half of their raters accept, and whether it is below the trigger."""
    by = ratings.groupBy(feature).agg(F.avg(F.when(accepted, 1.0).otherwise(0.0)).alias("accepted"))
    out = by.agg(F.count("*").alias("features"), F.avg("accepted").alias("mean_accepted"), rate(F.col("accepted") >= 0.5).alias("pass_rate"))
    return out.withColumn("fallback", F.col("pass_rate") < trigger)
