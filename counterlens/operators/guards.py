"""Ordered guards: the first one that a row fails drops it, and counters of the reasons come from the pass that keeps the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Guards = Sequence[tuple[str, Column]]
KEPT = "kept"


def first_reason(guards: Guards) -> Column:
    """The name of the first guard whose condition for dropping holds; NULL if none does. A NULL condition does not hold."""
    return F.coalesce(*[F.when(drops, name) for name, drops in guards])


def guarded(df: DataFrame, guards: Guards) -> tuple[DataFrame, Observation]:
    """The rows that pass all guards, and an observation with the number of rows dropped by each and of those kept.

    The counters are filled by the first action on the kept rows, in the same pass. Names
    must differ; a guard is judged only on rows that passed those before it.
    """
    names = [n for n, _ in guards]
    if len({*names, KEPT}) != len(names) + 1:
        raise ValueError("names of guards must differ")
    seen = Observation()
    reason = F.col("_reason")
    counters = [F.count_if(reason == n).alias(n) for n in names] + [F.count_if(reason.isNull()).alias(KEPT)]
    # a generator keeps the optimiser from writing the chain out once a counter
    marked = df.select("*", F.explode(F.array(first_reason(guards))).alias("_reason"))
    return marked.observe(seen, *counters).where(reason.isNull()).drop("_reason"), seen


def drop_counters(df: DataFrame, guards: Guards, keys: Sequence[str] = ()) -> DataFrame:
    """reason and n, by ``keys``: how many rows each guard dropped and how many are kept; reasons without a row are left out."""
    return df.groupBy(*keys, F.coalesce(first_reason(guards), F.lit(KEPT)).alias("reason")).agg(F.count("*").alias("n"))
