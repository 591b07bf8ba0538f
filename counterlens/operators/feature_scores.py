"""Scores of dictionary features and faithfulness, over tables of results.

Activations are a sparse table (row, feature, x); concepts a table (row, concept). The
matrix of features by rows is never made: counts are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(active: DataFrame, concepts: DataFrame, row: str) -> DataFrame:
    """feature, concept, tp, n_active, n_pos of every pair that occurs together."""
    tp = active.join(concepts, row).groupBy("feature", "concept").agg(F.count("*").alias("tp"))
    return tp.join(active.groupBy("feature").agg(F.count("*").alias("n_active")), "feature").join(concepts.groupBy("concept").agg(F.count("*").alias("n_pos")), "concept")


def f1(table: DataFrame) -> DataFrame:
    """``counts`` with f1 = 2 tp / (active + positive)."""
    return table.withColumn("f1", F.lit(2.0) * F.col("tp") / (F.col("n_active") + F.col("n_pos")))


def best_concept(scored: DataFrame) -> DataFrame:
    """Each feature's concept of largest f1; of equals (at twelve decimals) the first by name."""
    best = scored.groupBy("feature").agg(F.min(F.struct((-F.round("f1", 12)).alias("s"), "concept", "f1")).alias("b"))
    return best.select("feature", "b.concept", "b.f1")


def influence(semantic: Column, excess: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """alpha times the semantic score plus beta times the causal excess, which counts from 0 to 1."""
    return F.lit(alpha) * semantic + F.lit(beta) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), excess))


def spread(effects: DataFrame, keys: Sequence[str], value: str, reference: Column) -> DataFrame:
    """Mean, sample deviation and worst log ratio to a reference."""
    return effects.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.max(F.abs(F.ln(F.col(value) / reference))).alias("worst"))


def set_agreement(members: DataFrame, group: str, member: str) -> DataFrame:
    """x, y, jaccard, only_x, only_y of every two groups' sets of members; groups without a common member are left out."""
    sets = members.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    sizes = sets.groupBy("g").agg(F.count("*").alias("n"))
    common = sets.alias("a").join(sets.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.g") < F.col("b.g"))).groupBy(F.col("a.g").alias("x"), F.col("b.g").alias("y")).agg(F.count("*").alias("k"))
    size = lambda side: sizes.select(F.col("g").alias(side), F.col("n").alias(f"n_{side}"))
    out = common.join(size("x"), "x").join(size("y"), "y")
    return out.select("x", "y", (F.col("k") / (F.col("n_x") + F.col("n_y") - F.col("k"))).alias("jaccard"), (F.col("n_x") - F.col("k")).alias("only_x"), (F.col("n_y") - F.col("k")).alias("only_y"))


def faithfulness(items: DataFrame, keys: Sequence[str], clean: str, without: str, only: str) -> DataFrame:
    """Means over a grid of rationale sizes: what taking the rationale away costs, what keeping it alone costs, and how many items.

    ``without`` and ``only`` are arrays over the grid of the probability that is left.
    """
    drop = lambda c: F.transform(F.col(c), lambda p: F.col(clean) - p)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    x = items.withColumns({"_comp": drop(without), "_suff": drop(only)})
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(mean(F.col("_comp"))).alias("aopc_comprehensiveness"), F.avg(mean(F.col("_suff"))).alias("aopc_sufficiency"))


def rationale(scores: Column, share: float) -> Column:
    """Places (from 0) of the top share of an array of scores, largest first, one at least; ties go to the earlier place."""
    k = F.greatest(F.lit(1), F.bround(F.size(scores) * F.lit(share)).cast("int"))
    placed = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(placed), F.lit(1), k), lambda x: x.i)


def contraction(old: Column, new: Column) -> Column:
    """Aggregate: one less the share of positive excess that is left."""
    positive = lambda c: F.sum(F.greatest(c, F.lit(0.0)))
    return F.lit(1.0) - F.try_divide(positive(new), positive(old))


def perplexity(windows: DataFrame, keys: Sequence[str], nll: str, length: str, end: str) -> DataFrame:
    """exp of the summed losses of strided windows (mean loss times targets) over the end of the last."""
    return windows.groupBy(*keys).agg(F.exp(F.try_divide(F.sum(F.col(nll) * F.col(length)), F.max(end).cast("double"))).alias("ppl"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def rescale(vectors: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Factor that brings vectors to a mean length of the square root of their dimension."""
    return vectors.groupBy(*keys).agg((F.sqrt(F.max(F.size(vector)).cast("double")) / F.avg(norm(F.col(vector)))).alias("scale"))


def top_k_code(pre: Column, k: int) -> Column:
    """The k largest entries of an array, negative ones as 0, all others 0; of equals the earlier."""
    placed = F.transform(pre, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    chosen = F.transform(F.slice(F.array_sort(placed), 1, k), lambda p: p.i)
    return F.transform(pre, lambda x, i: F.when(F.array_contains(chosen, i), F.greatest(x.cast("double"), F.lit(0.0))).otherwise(0.0))


def gated_code(pre: Column, log_threshold: Column | float) -> Column:
    """Entries above exp(threshold), all others 0."""
    at = F.exp(log_threshold if isinstance(log_threshold, Column) else F.lit(float(log_threshold)))
    return F.transform(pre, lambda x: F.when((x > at) & (x > 0), x.cast("double")).otherwise(0.0))
