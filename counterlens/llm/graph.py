"""Connected components of a link table, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm.shared import Scratch, with_each

MAX_ROUNDS = 60
#: A task can hold so many links; of more, those of hot vertices are dealt by broadcast of their minima.
LINKS_A_TASK = 1_000_000


def _with_lows(links: DataFrame, lows: DataFrame, total: int) -> DataFrame:
    return links.join(lows.drop("c"), "u") if total <= LINKS_A_TASK else with_each(links, lows, ["u"], "c", total).drop("c")


def _stars(links: DataFrame, small: bool, total: int) -> DataFrame:
    """One contraction of links (u, v) with u > v; each vertex meets its smallest neighbour.

    The minimum is pre-aggregated and joined back, so no vertex's neighbours are
    gathered in one place.
    """
    if small:
        lows = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        moved = _with_lows(links, lows, total)
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(lows.select("u", F.col("m").alias("v")))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return _with_lows(both, lows, 2 * total).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(u, v): every vertex that has a link and is not its component's smallest, with that smallest.

    ``links`` has columns a, b in any order; self-links and repeated links are allowed.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.table(edges, f"{name}-0")
    mark = _mark(edges)
    for k in range(1, MAX_ROUNDS):
        edges = scratch.table(_stars(_stars(edges, False, mark[0]).distinct(), True, mark[0]).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        mark, before = _mark(edges), mark
        if mark == before:
            return edges
    raise RuntimeError("the components did not settle")
