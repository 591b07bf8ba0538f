"""Running sums and ranks over long orders, without a task that holds a whole order.

Rows are range-partitioned by keys and order, ties included, and stored with the number of
their range; totals by key and range are summed ahead (a small table), and a window runs
inside a range only. So a window over one key, or none, spreads over as many tasks as there
are ranges, and a value that many rows share is split by what comes after it in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.sources import files

RANGES = 64


def in_ranges(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` stored with _range, which grows with the order; NULL comes first. Equal rows of the order share a range.

    It is stored because a second run may cut elsewhere. Without ``ranges`` the engine
    settles their number.
    """
    path = files.scratch_path(df.sparkSession, "ranges")
    (df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], total: str | None = None) -> DataFrame:
    """``df`` with inclusive running sums by ``keys`` in the order of ``order``.

    ``sums`` maps new names to integer columns; ``total`` names the count of the key's rows.
    """
    placed = in_ranges(df, [*keys, *order])
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_p_{n}") for n, c in sums.items()], F.count("*").alias("_n"))
    carried = [F.coalesce(F.sum(f"_p_{n}").over(ahead), F.lit(0)).alias(f"_a_{n}") for n in sums]
    parts = parts.select(*keys, "_range", *carried, *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    # keys may be NULL, so sides are matched null-safely
    right = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[c for c in parts.columns if c not in (*keys, "_range")])
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = placed.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(right, match)
    out = out.withColumns({n: (F.col(f"_a_{n}") + F.col(f"_i_{n}")).cast("long") for n in sums})
    return out.select(*df.columns, *sums, *([total] if total else []))


def index_quantile(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], share: float) -> DataFrame:
    """By keys the value at place int(share * (n - 1)) of the ascending order, from 0; no interpolation."""
    rows = running(df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1).cast("long")), keys, [value, *tie], {"_place": "_one"}, total="_rows")
    return rows.where(F.col("_place") == F.floor(F.lit(share) * (F.col("_rows") - 1)) + 1).select(*keys, value)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the value of the row before in the order of a key; NULL for the first. Rows meet by their place, so no task holds an order."""
    rows = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {"_place": "_one"}).drop("_one")
    before = rows.select(*keys, (F.col("_place") + 1).alias("_place"), F.col(value).alias(name))
    return rows.join(before, [*keys, "_place"], "left").select(*df.columns, name)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place", total: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with the place (1, 2, ...) of each row of a key in the order of a hash.

    ``order`` begins with a non-negative integer hash below 2**31 or so, whose remainder
    in equal steps makes the ranges; no quantiles are asked for.
    """
    step = F.floor(F.col(order[0]) / F.lit(-(-1000003 // ranges)))
    placed = df.withColumn("_range", step.cast("int"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    parts = parts.select(*keys, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = placed.withColumn("_inside", inside).join(parts, [*keys, "_range"])
    return out.select(*df.columns, (F.col("_ahead") + F.col("_inside")).cast("long").alias(name), *([total] if total else []))
