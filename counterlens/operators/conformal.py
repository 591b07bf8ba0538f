"""Abstention thresholds with a finite-sample bound, for any table of (uncertainty, correct)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.functions.binomial import tail_of, upper_limit
from counterlens.operators.ordered import running

NOTHING = float("-inf")


def min_certifiable_n(alpha: float = 0.1, delta: float = 0.1) -> int:
    """Fewest retained items, all right, that certify an error rate of alpha."""
    return math.ceil(math.log(delta) / math.log(1 - alpha) - 1e-12)


def pool(preds: DataFrame, keys: list[str], open_: Column, score: str = "u") -> DataFrame:
    """Rows that calibrate a threshold: the open ones, or all where none is open; of those, the ones with a finite score where there are any.

    ``open_`` says that a row is not decided otherwise. ``rule`` tells what was taken:
    ``finite`` or ``open`` of the open rows, ``all_finite`` or ``all`` of all rows.
    """
    fine = F.coalesce(F.abs(score) < float("inf"), F.lit(False))
    kinds = preds.groupBy(*keys).agg(F.count_if(open_).alias("_open"), F.count_if(open_ & fine).alias("_finite"), F.count_if(fine).alias("_any"))
    some = F.col("_open") > 0
    rule = F.when(some & (F.col("_finite") > 0), "finite").when(some, "open").when(F.col("_any") > 0, "all_finite").otherwise("all")
    r = F.col("rule")
    taken = F.when(r == "finite", open_ & fine).when(r == "open", open_).when(r == "all_finite", fine).otherwise(F.lit(True))
    return preds.join(kinds.select(*keys, rule.alias("rule")), keys).where(taken)


def calibrate(pool: DataFrame, keys: list[str], alpha: float = 0.1, delta: float = 0.1, rule: str = "conformal") -> DataFrame:
    """tau, retained and certifiable by keys: a row is retained if its u is at most tau; -inf retains nothing.

    ``pool`` has u, ok and, for the legacy rule, a column ``seq`` that orders ties. The
    conformal rule takes the largest distinct u whose retained set has an upper error
    limit of at most alpha, which is that P(X <= errors) at rate alpha is at most delta.
    Rows are first aggregated to distinct values, so a window holds values, not rows.
    The legacy rule puts rows in order, in ranges of u.
    """
    if rule == "legacy":
        rows = pool.withColumns({"_one": F.lit(1).cast("long"), "_bad": (~F.col("ok")).cast("long")})
        ranked = running(rows, keys, ["u", "seq"], {"place": "_one", "bad": "_bad"})
        found = F.max_by("u", F.when(F.col("bad") / F.col("place") <= alpha, F.col("place")))
        return ranked.groupBy(*keys).agg(F.coalesce(found, F.min("u")).alias("tau"))
    if rule != "conformal":
        raise ValueError(f"unknown calibration rule {rule!r}")
    cells = pool.groupBy(*keys, "u").agg(F.count("*").alias("m"), F.count_if(~F.col("ok")).alias("w"))
    upto = Window.partitionBy(*keys).orderBy("u")
    cells = cells.select(*keys, "u", F.sum("m").over(upto).alias("n"), F.sum("w").over(upto).alias("k"))
    sure = cells.where("k < n").withColumn("tail", tail_of("k", "n", F.lit(float(alpha)))).withColumn("sure", F.col("tail") <= delta)
    every = cells.groupBy(*keys).agg(F.lit(1).alias("_any")).drop("_any")
    best = sure.where("sure").groupBy(*keys).agg(F.max("u").alias("tau"), F.max("n").alias("retained"))
    out = every.join(best, keys, "left")
    return out.select(*keys, F.coalesce("tau", F.lit(NOTHING)).alias("tau"), F.coalesce("retained", F.lit(0)).alias("retained"), F.col("tau").isNotNull().alias("certifiable"))


def diagnostics(pool: DataFrame, taus: DataFrame, keys: list[str], delta: float = 0.1) -> DataFrame:
    """What a threshold achieves on a pool: retained, errors, coverage, error and its upper limit."""
    kept = F.col("u") <= F.col("tau")
    by = pool.join(taus.select(*keys, "tau"), keys).groupBy(*keys, "tau").agg(F.count("*").alias("n"), F.count_if(kept).alias("retained"), F.count_if(kept & ~F.col("ok")).alias("errors"))
    return by.withColumns({"coverage": F.col("retained") / F.col("n"), "selective_error": F.try_divide("errors", "retained"), "cp_upper_at_tau": upper_limit("errors", "retained", F.lit(delta)), "certifiable": F.col("tau") > NOTHING})
