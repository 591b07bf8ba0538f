"""Exact tests and bootstrap intervals over prediction tables of any size.

The unit that is resampled is the item, the pair or the cluster, never a bin. Bootstraps
use what is sufficient: flags need only their count and sum, an area under the curve
needs the rows by distinct score, a ratio the clusters by their (sum, count). A cell of m
equal units gets the weight of m of them at once; weights are Poisson, drawn by a
generator that is keyed by the cell itself, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterlens.functions import binomial
from counterlens.operators.ordered import in_ranges

FEWEST = 10
CELLS_A_TASK = 20_000
DRAWS_AT_ONCE = 500


def mcnemar(paired: DataFrame, before: Column, after: Column, keys: Sequence[str]) -> DataFrame:
    """b01 (wrong, then right), b10 and the exact two-sided p of rows that hold both outcomes; p is 1 without discordant rows."""
    by = paired.groupBy(*keys).agg(F.count_if(~before & after).alias("b01"), F.count_if(before & ~after).alias("b10"))
    p = F.lit(2.0) * binomial.tail_of(F.least("b01", "b10"), F.col("b01") + F.col("b10"), F.lit(0.5))
    return by.withColumn("p_value", F.when(F.col("b01") + F.col("b10") == 0, 1.0).otherwise(F.least(F.lit(1.0), p)))


def against(preds: DataFrame, item: str, variant: str, base: str, flag: str) -> DataFrame:
    """variant, before, after: each item's outcome under every variant next to that under ``base``.

    One aggregation by item, no self-join; items that ``base`` lacks are left out.
    """
    own = F.map_from_entries(F.collect_list(F.struct(variant, flag))).alias("_all")
    rows = preds.groupBy(item).agg(own).withColumn("before", F.try_element_at("_all", F.lit(base))).where("before IS NOT NULL")
    return rows.select(item, "before", F.explode("_all").alias(variant, "after")).where(F.col(variant) != base)


def holm(tests: DataFrame, name: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p values of a family of tests (one row a test, so families are small)."""
    line = Window.partitionBy(*keys).orderBy(p, name)
    left = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(line) + 1
    stepped = tests.withColumn("_step", left * F.col(p))
    running = F.max("_step").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("_step")


def mean_interval(df: DataFrame, flag: Column, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of the bootstrapped mean of a flag.

    Resampling n flags of which k are set gives a Binomial(n, k / n) count, so the
    interval is its quantiles over n: what replicates tend to, without drawing any.
    """
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    at = lambda q: binomial.quantile_of(F.lit(q), F.col("n"), F.col("k") / F.col("n")) / F.col("n")
    return by.withColumns({"lo": at((1 - level) / 2), "hi": at((1 + level) / 2)})


def _interval(values: str, level: float) -> list[Column]:
    return [F.percentile(values, F.lit((1 - level) / 2)).alias("lo"), F.percentile(values, F.lit((1 + level) / 2)).alias("hi")]


def _generator(seed: int, *idents: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *[i & 0xFFFFFFFFFFFFFFFF for i in idents]])))


def difference_interval(rates: DataFrame, keys: Sequence[str], replicates: int = 5000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bootstrap interval of k1 / n1 - k2 / n2 of two separate samples (columns k1, n1, k2, n2); NULL with fewer than ten in one."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def interval(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
        out = []
        for a, m, b, n in zip(k1, n1, k2, n2):
            if m < FEWEST or n < FEWEST:
                out.append(None)
                continue
            g = _generator(seed, int(a), int(m), int(b), int(n))
            d = g.binomial(int(m), a / m, replicates) / m - g.binomial(int(n), b / n, replicates) / n
            out.append(np.quantile(d, [(1 - level) / 2, (1 + level) / 2]).tolist())
        return pd.Series(out)

    made = rates.withColumn("_i", interval("k1", "n1", "k2", "n2"))
    return made.select(*keys, (F.try_divide("k1", "n1") - F.try_divide("k2", "n2")).alias("difference"), F.col("_i")[0].alias("lo"), F.col("_i")[1].alias("hi"))


def cluster_interval(df: DataFrame, cluster: str, flag: Column, keys: Sequence[str], replicates: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Interval of the mean of a flag when whole clusters are resampled; empty groups give no row."""
    sums = df.groupBy(*keys, cluster).agg(F.count("*").alias("_c"), F.count_if(flag).alias("_s"))
    table = sums.groupBy(*keys, "_c", "_s").agg(F.count("*").alias("_m"))
    draw = _drawn(table, keys, replicates, seed)
    by = draw.groupBy(*keys, "rep").agg((F.sum("ws") / F.nullif(F.sum("wc"), F.lit(0))).alias("_x"))
    return by.groupBy(*keys).agg(*_interval("_x", level))


def _drawn(table: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Weighted sums ws, wc of (_s, _c) cells by key and replicate, a partial sum a batch."""
    kinds = T.StructType([f for f in table.schema if f.name in keys]).add("rep", T.IntegerType()).add("ws", T.DoubleType()).add("wc", T.DoubleType())

    def run(batches):
        for batch in batches:
            for key, part in batch.groupby(list(keys), dropna=False) if keys else [((), batch)]:
                ws, wc = np.zeros(replicates), np.zeros(replicates)
                for s, c, m in zip(part["_s"], part["_c"], part["_m"]):
                    w = _generator(seed, int(s), int(c)).poisson(m, replicates)
                    ws, wc = ws + w * s, wc + w * c
                made = pd.DataFrame({"rep": np.arange(replicates, dtype=np.int32), "ws": ws, "wc": wc})
                for k, v in zip(keys, key if isinstance(key, tuple) else (key,)):
                    made[k] = v
                yield made[[f.name for f in kinds]]

    return table.mapInPandas(run, kinds)


def _concordance(keys: Sequence[str], schema: T.StructType, replicates: int, seed: int):
    """Of the cells of one range of scores: weights of wrong and right rows, and wrong above right, by replicate.

    Replicate -1 weighs every cell by its rows.
    """

    def run(key, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["score", "ident"], kind="stable")
        score, wrong, m = cells["score"].to_numpy(), cells["wrong"].to_numpy(), cells["m"].to_numpy()
        block = np.cumsum(np.concatenate(([0], (np.diff(score) != 0).astype(int))))
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        parts = []
        generators = [_generator(seed, int(i)) for i in cells["ident"]]
        for at in [-1, *range(0, replicates, DRAWS_AT_ONCE)]:
            n = 1 if at < 0 else min(DRAWS_AT_ONCE, replicates - at)
            w = m[:, None].astype(float) if at < 0 else np.stack([g.poisson(x, n) for g, x in zip(generators, m)]).astype(float)
            pos, neg = (np.add.reduceat(np.where((wrong == side)[:, None], w, 0), starts, axis=0) for side in (True, False))
            below = np.cumsum(neg, axis=0) - neg / 2
            parts.append((np.arange(at, at + n), pos.sum(0), neg.sum(0), (pos * below).sum(0)))
        rep, pos, neg, conc = (np.concatenate(x) for x in zip(*parts))
        made = pd.DataFrame({"rep": rep.astype(np.int32), "pos": pos, "neg": neg, "conc": conc})
        for name, v in zip([*keys, "signal", "_range"], key):
            made[name] = v
        return made[[f.name for f in schema]]

    return run


def auroc_replicates(df: DataFrame, signals: dict[str, str], wrong: Column, keys: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """(keys, rep, signal, auroc, n): areas of every signal under the same weights; rep -1 is what was observed.

    Only rows with all signals count. Cells are distinct (signals, wrong); a task holds
    one range of scores, and ranges are combined by the right rows below each.
    """
    whole = df.select(*keys, *[F.col(c).cast("double").alias(f"_s_{n}") for n, c in signals.items()], F.coalesce(wrong, F.lit(True)).alias("wrong")).na.drop(subset=[f"_s_{n}" for n in signals])
    names = [f"_s_{n}" for n in signals]
    cells = whole.groupBy(*keys, *names, "wrong").agg(F.count("*").alias("m")).withColumn("ident", F.xxhash64(*names, "wrong"))
    long = cells.select(*keys, "wrong", "m", "ident", F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"_s_{n}").alias("score")) for n in signals])))
    ranges = max(1, -(-long.count() // CELLS_A_TASK))
    placed = in_ranges(long, ["score"], ranges)
    kinds = T.StructType([f for f in placed.schema if f.name in (*keys, "signal", "_range")])
    for name, kind in (("rep", T.IntegerType()), ("pos", T.DoubleType()), ("neg", T.DoubleType()), ("conc", T.DoubleType())):
        kinds = kinds.add(name, kind)
    by = placed.groupBy(*keys, "signal", "_range").applyInPandas(_concordance(keys, kinds, replicates, seed), kinds)
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys, "signal", "rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    summed = by.withColumn("conc", F.col("conc") + F.col("pos") * lower).groupBy(*keys, "signal", "rep").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "conc")])
    return summed.select(*keys, "signal", "rep", F.try_divide("conc", F.col("pos") * F.col("neg")).alias("auroc"), (F.col("pos") + F.col("neg")).alias("n"))


def auroc_interval(df: DataFrame, score: str, wrong: Column, keys: Sequence[str], replicates: int = 5000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Area under the curve with its percentile interval; replicates of one class only are left out."""
    made = auroc_replicates(df, {"a": score}, wrong, keys, replicates, seed)
    drawn = F.when(F.col("rep") >= 0, F.col("auroc"))
    return made.withColumn("_x", drawn).groupBy(*keys).agg(F.max(F.when(F.col("rep") < 0, F.col("auroc"))).alias("auroc"), *_interval("_x", level))


def paired_delta(df: DataFrame, score_a: str, score_b: str, wrong: Column, keys: Sequence[str], replicates: int = 5000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """n, both areas, their difference on the same rows, its interval and two-sided p; no row below ten rows or with one class."""
    made = auroc_replicates(df, {"a": score_a, "b": score_b}, wrong, keys, replicates, seed)
    area = lambda s: F.max(F.when(F.col("signal") == s, F.col("auroc")))
    by = made.groupBy(*keys, "rep").agg(area("a").alias("a"), area("b").alias("b"), F.max("n").alias("n")).withColumn("d", F.col("a") - F.col("b"))
    seen, drawn = F.col("rep") < 0, F.when(F.col("rep") >= 0, F.col("d"))
    out = by.withColumn("_x", drawn).groupBy(*keys).agg(
        F.max(F.when(seen, F.col("n"))).cast("long").alias("n"),
        F.max(F.when(seen, F.col("a"))).alias("auroc_a"),
        F.max(F.when(seen, F.col("b"))).alias("auroc_b"),
        F.max(F.when(seen, F.col("d"))).alias("delta"),
        *_interval("_x", level),
        F.least(F.lit(1.0), 2 * F.least(F.avg(F.when(F.col("_x").isNotNull(), (F.col("_x") <= 0).cast("double"))), F.avg(F.when(F.col("_x").isNotNull(), (F.col("_x") >= 0).cast("double"))))).alias("p"),
    )
    return out.where(f"n >= {FEWEST} AND delta IS NOT NULL")
