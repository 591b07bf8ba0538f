"""Texts of items from a table of families: explicit and implicit wording, distractors, and the skeleton of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results that bear on none of the rules, with the lowest of five values and the step to the next.
RESULTS = [("ferritin", "ug/L", 64, 23), ("folate", "nmol/L", 15, 4), ("calcium", "mmol/L", 2.21, 0.06), ("white cells", "x10^9/L", 4.6, 1.3), ("uric acid", "umol/L", 233, 37), ("vitamin B6", "nmol/L", 52, 11), ("lactate", "mmol/L", 0.7, 0.2), ("amylase", "U/L", 41, 9), ("zinc", "umol/L", 11.5, 1.2)]
DISTRACTORS = {f"{name} {{v}} {unit}": " ".join(f"{low + i * step:g}" for i in range(5)) for name, unit, low, step in RESULTS}
FACTOR, BEFORE = "<FACTOR>", "The team proposes"


def distractors(draw: Column, n: int = 3) -> Column:
    """``n`` different distractor results by a draw (a whole number); equal draws, equal results."""
    made = [F.replace(F.lit(t), F.lit("{v}"), F.element_at(F.array(*map(F.lit, v.split())), (F.floor(draw / (7 + i)) % len(v.split()) + 1).cast("int"))) for i, (t, v) in enumerate(DISTRACTORS.items())]
    start = (draw % len(made)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(F.array(*made), (start + k) % len(made) + 1)), ", ")


def render(items: DataFrame, families: DataFrame, value: Column, draw: Column) -> DataFrame:
    """``items`` with vignette and skeleton: the family's wording (implicit where the item says so) around the value, with distractors before the proposal.

    ``families`` (small) has family, explicit and implicit, texts in which {value} stands
    for the factor; a family without an implicit text is always explicit. The skeleton has
    a mark in place of the value, so the arms of a pair have equal skeletons.
    """
    x = items.join(F.broadcast(families), "family", "left").withColumns({"_value": value, "_labs": distractors(draw)})
    hidden = (F.col("presentation") == "implicit") & F.col("implicit").isNotNull()
    form = F.when(hidden, F.col("implicit")).otherwise(F.col("explicit"))
    place = F.length(form) - F.locate(BEFORE[::-1], F.reverse(form)) - F.lit(len(BEFORE) - 2)
    others = F.concat(F.lit("Other results: "), F.col("_labs"), F.lit(". "))
    spliced = F.when(form.contains(BEFORE), F.concat(form.substr(F.lit(1), place - 1), others, form.substr(place, F.length(form)))).otherwise(F.concat(form, F.lit(" "), F.rtrim(others)))
    whole = lambda v: F.replace(spliced, F.lit("{value}"), v)
    return x.select(*items.columns, whole(F.col("_value")).alias("vignette"), whole(F.lit(FACTOR)).alias("skeleton"))


def minimal_pairs(rendered: DataFrame) -> DataFrame:
    """pair_id of pairs whose arms differ in more than the factor."""
    return rendered.groupBy("pair_id").agg(F.count_distinct("skeleton").alias("n")).where("n > 1").select("pair_id")
