"""Discrimination and calibration of an uncertainty score: ranks, risk-coverage, operating points.

``df`` has a score (larger is less sure) and a boolean that says whether the row is wrong
or right. Ranks and curves aggregate to distinct scores first, so a window holds scores,
not rows; where rows themselves are put in order, the running sums of ``ordered`` cut the
order into ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.operators.ordered import running


def cells(df: DataFrame, score: str, wrong: Column, keys: Sequence[str]) -> DataFrame:
    """Rows and wrong rows by distinct score."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"))


def average_ranks(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with the rank that its rows share: the mean of the places they take."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("score"))
    return table.withColumn("avg_rank", upto - (F.col("n") - 1) / F.lit(2.0))


def auroc(df: DataFrame, score: str, wrong: Column, keys: Sequence[str]) -> DataFrame:
    """Chance that a wrong row scores above a right one, ties counting half; NULL with one class only. NULL scores take no part."""
    ranked = average_ranks(cells(df.where(F.col(score).isNotNull()), score, wrong, keys), keys)
    by = ranked.groupBy(*keys).agg(F.sum(F.col("wrong") * F.col("avg_rank")).alias("ranks"), F.sum("wrong").alias("p"), F.sum("n").alias("all"))
    p, q = F.col("p").cast("double"), (F.col("all") - F.col("p")).cast("double")
    return by.select(*keys, F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("auroc"))


def ece(df: DataFrame, confidence: Column, right: Column, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal, half-open bins from the smallest to just above the largest confidence."""
    rows = df.select(*keys, confidence.alias("conf"), F.when(right, 1.0).otherwise(0.0).alias("ok")).where("conf IS NOT NULL")
    edges = rows.groupBy(*keys).agg(F.min("conf").alias("lo"), ((F.max("conf") + 1e-9 - F.min("conf")) / float(bins)).alias("w"))
    placed = rows.join(edges, list(keys)).withColumn("bin", F.floor((F.col("conf") - F.col("lo")) / F.col("w")))
    by = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("ok").alias("ok"))
    return by.groupBy(*keys).agg(F.count("*").alias("bins"), (F.sum(F.col("n") * F.abs(F.col("ok") - F.col("conf"))) / F.sum("n")).alias("ece"))


def risk_coverage(df: DataFrame, score: str, wrong: Column, keys: Sequence[str]) -> DataFrame:
    """One point a distinct score: rows kept up to it, coverage and error. A missing score is infinite."""
    filled = df.withColumn("_score", F.coalesce(F.col(score), F.lit(float("inf"))))
    by = cells(filled, "_score", wrong, keys)
    upto, every = Window.partitionBy(*keys).orderBy("score"), Window.partitionBy(*keys)
    kept = F.sum("n").over(upto)
    return by.select(*keys, F.col("score").alias("threshold"), kept.alias("kept"), (kept / F.sum("n").over(every)).alias("coverage"), (F.sum("wrong").over(upto) / kept).alias("error"))


def aurc_grid(curve: DataFrame, keys: Sequence[str], points: int = 1000) -> DataFrame:
    """Mean error over a uniform grid of coverages, each read from the first point that reaches it.

    A point answers for the grid places between the coverage before it and its own, so
    the grid is counted, not joined.
    """
    before = F.coalesce(F.lag("coverage").over(Window.partitionBy(*keys).orderBy("coverage")), F.lit(0.0))
    place = lambda c: F.floor(c * points + 1e-9)
    weighed = curve.select(*keys, "error", (place(F.col("coverage")) - place(before)).alias("points"))
    return weighed.groupBy(*keys).agg((F.sum(F.col("error") * F.col("points")) / F.sum("points")).alias("aurc"))


def prefixes(df: DataFrame, score: str, tie: Sequence[str], wrong: Column, keys: Sequence[str]) -> DataFrame:
    """Rows in score order with their place (1, 2, ...), the risk up to them, and the size of their group."""
    rows = df.where(F.col(score).isNotNull()).withColumn("_wrong", F.when(wrong, 1).otherwise(0).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    out = running(rows, keys, [score, *tie], {"place": "_one", "errors": "_wrong"}, total="rows")
    return out.withColumn("risk", F.col("errors") / F.col("place")).drop("_wrong", "_one")


def aurc_prefixes(df: DataFrame, score: str, tie: Sequence[str], wrong: Column, keys: Sequence[str]) -> DataFrame:
    """Mean, over all prefixes of the score order, of the share of wrong rows."""
    return prefixes(df, score, tie, wrong, keys).groupBy(*keys).agg(F.avg("risk").alias("aurc"))


def fraction_grid(df: DataFrame, score: str, tie: Sequence[str], wrong: Column, keys: Sequence[str], tenths: int = 10) -> DataFrame:
    """Risk of the best k of n rows for each tenth, k being the fraction of n rounded half to even, one at least."""
    rows = prefixes(df, score, tie, wrong, keys)
    grid = df.sparkSession.range(1, tenths + 1).select(F.col("id").alias("tenth"))
    k = F.greatest(F.lit(1), F.bround(F.col("tenth") * F.col("rows") / float(tenths)).cast("long"))
    return rows.join(grid, F.col("place") == k).select(*keys, "tenth", F.col("place").alias("kept"), "risk")


def operating_points(curve: DataFrame, targets: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The point nearest each coverage target; of equally near ones the lower score."""
    aim = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    point = F.struct(F.round(F.abs(F.col("coverage") - F.col("target")), 12), "threshold", "kept", "coverage", "error")
    near = curve.select("*", aim).groupBy(*keys, "target").agg(F.min(point).alias("p"))
    return near.select(*keys, "target", "p.kept", "p.coverage", "p.error")


def reach(curve: DataFrame, keys: Sequence[str], floor: float, alpha: float) -> DataFrame:
    """Least error at a coverage of at least ``floor``, and the largest coverage with an error of at most ``alpha``."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("coverage") >= floor, F.col("error"))).alias("floor_error"), F.max(F.when(F.col("error") <= alpha, F.col("coverage"))).alias("reach"))


def point_at(curve: DataFrame, taus: DataFrame, keys: Sequence[str], tau: str = "tau") -> DataFrame:
    """coverage, error, kept and state of each threshold (keys, tau) on the curve of its keys; one row a threshold.

    The state is ``on`` where the curve has a point at or below tau, of which the last one
    counts. It is ``none`` for a tau of -inf, which retains nothing, and ``below`` for one
    under the first point; coverage is 0 and there is no error then. A NULL tau is no
    threshold and has no row.
    """
    asked = taus.where(F.col(tau).isNotNull()).select(*keys, F.col(tau).alias("_tau")).distinct()
    reached = curve.join(asked, list(keys)).where(F.col("threshold") <= F.col("_tau"))
    last = reached.groupBy(*keys, "_tau").agg(F.max(F.struct("threshold", "kept", "coverage", "error")).alias("_p"))
    out = asked.join(last, [*keys, "_tau"], "left")
    state = F.when(F.col("_tau") == float("-inf"), "none").when(F.col("_p").isNull(), "below").otherwise("on")
    on = lambda c: F.when(state == "on", F.col(f"_p.{c}"))
    return out.select(*keys, F.col("_tau").alias(tau), state.alias("state"), F.coalesce(on("kept"), F.lit(0).cast("long")).alias("kept"), F.coalesce(on("coverage"), F.lit(0.0)).alias("coverage"), on("error").alias("error"))
