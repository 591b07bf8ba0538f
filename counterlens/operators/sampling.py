"""Seeded splits, samples, folds and repeats: every draw is an integer hash, so it can be repeated anywhere.

Places in an order are taken in ranges of the hash (``ordered.numbered``), so no task
holds a whole split or stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.operators.ordered import numbered, running

PRIME = 1000003


def hashed(number: Column, factor: int) -> Column:
    """A draw below ``PRIME`` of a whole number; other factors draw apart from each other."""
    return F.pmod(number * F.lit(factor), F.lit(PRIME))


def text_draw(text: Column) -> Column:
    """A draw below ``PRIME`` of a text, from the first 28 bits of its md5."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(PRIME))


def grouped_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """group, fold: groups dealt in turn in the order of a hash, so folds differ by one group at most."""
    groups = df.select(group).distinct().withColumn("_h", text_draw(F.col(group)))
    return numbered(groups, [], ["_h", group]).select(group, ((F.col("place") - 1) % folds).alias("fold"))


def split(units: DataFrame, key: str, draw: Column, shares: dict[str, float], rest: str, by: Sequence[str] = ()) -> DataFrame:
    """key and split: units in the order of their draws, cut at the cumulative shares; the first split gets one at least."""
    placed = numbered(units.withColumn("_h", draw), list(by), ["_h", key], total="_n")
    out, upto, first = None, 0.0, True
    for name, share in shares.items():
        upto += share
        cut = F.floor(F.col("_n") * F.lit(upto) + 1e-9)
        test = F.col("place") <= (F.greatest(F.lit(1), cut) if first else cut)
        out = F.when(test, name) if out is None else out.when(test, name)
        first = False
    return placed.select(*units.columns, out.otherwise(rest).alias("split"))


def sample(df: DataFrame, strata: Sequence[str], draw: Column, tie: str, size: Column | int) -> DataFrame:
    """The first ``size`` rows of each stratum in the order of their draws (a group limit runs before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, tie))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def plant_repeats(items: DataFrame, key: str, draw: Column, share: float) -> DataFrame:
    """``items`` with a share of them again, under their key with an R, and ``repeat_of``; one repeat at least.

    The share of n is rounded half to even.
    """
    placed = numbered(items.withColumn("_h", draw), [], ["_h", key], total="_n")
    wanted = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("long"))
    again = placed.where(F.col("place") <= wanted).withColumn("repeat_of", F.col(key)).withColumn(key, F.concat(key, F.lit("R")))
    return items.withColumn("repeat_of", F.lit(None).cast("string")).unionByName(again.drop("_h", "place", "_n"))


def rater_orders(items: DataFrame, key: str, raters: Sequence[str]) -> DataFrame:
    """Each rater's own order of the items, by a hash of rater and key."""
    rows = items.withColumn("rater", F.explode(F.array(*map(F.lit, raters))))
    return rows.withColumn("order_hash", F.sha2(F.concat_ws("|", "rater", key), 256))


def within(df: DataFrame, keys: Sequence[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows whose running sum of sizes, in order, stays within the budget."""
    return running(df, keys, [order], {"running": size}).where(F.col("running") <= budget)
