"""Evaluating distinct prompts once, in fixed batches of one length, and handing results back to all items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterlens.operators.ordered import running

Evaluate = Callable[[list[str]], list[tuple]]


def in_batches(items: DataFrame, prompt: str, length: Column, size: int) -> tuple[DataFrame, Observation]:
    """The distinct prompts with length, batch and slot, and an observation: distinct, batches.

    A batch holds prompts of one length, in their own order, so its make-up does not depend
    on the order in which items arrive. Prompts are placed by ranges of (length, prompt):
    a length that very many prompts share is no single task. A NULL prompt is none.
    """
    distinct = items.select(F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").distinct()
    placed = running(distinct.select("prompt", length.alias("length"), F.lit(1).cast("long").alias("_one")), ["length"], ["prompt"], {"_place": "_one"})
    slot = F.col("_place") - 1
    batches = placed.select("prompt", "length", F.floor(slot / size).alias("batch"), (slot % size).cast("int").alias("slot"))
    seen = Observation()
    return batches.observe(seen, F.count("*").alias("distinct"), F.count_if(F.col("slot") == 0).alias("batches")), seen


def _run(evaluate: Evaluate, size: int, names: list[str]):
    def answered(part: pd.DataFrame) -> pd.DataFrame:
        prompts = part["prompt"].tolist()
        made = evaluate(prompts + prompts[-1:] * (size - len(prompts)))
        if len(made) != size:
            raise ValueError(f"{len(made)} results for a batch of {size}")
        return pd.concat([part.reset_index(drop=True), pd.DataFrame(made[: len(prompts)], columns=names)], axis=1)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for chunk in chunks:
            held = chunk if held is None else pd.concat([held, chunk])
            key = list(zip(held["length"], held["batch"]))
            done = [k != key[-1] for k in key]  # the last batch may go on in the next chunk
            for _, part in held[done].groupby(["length", "batch"], sort=False):
                yield answered(part)
            held = held[[not d for d in done]]
        if held is not None and len(held):
            yield answered(held)

    return run


def evaluate_once(items: DataFrame, prompt: str, evaluate: Evaluate, results: str, length: Column, size: int = 8) -> tuple[DataFrame, Observation]:
    """``items`` with what ``evaluate`` made of their prompts (columns ``results``, a schema), with length and batch; and the counters.

    ``evaluate`` is given exactly ``size`` prompts of one length; the last batch of a length
    is filled up with its last prompt, and what is made of the filling is thrown away.
    ``length`` is an expression over a column prompt. The filling is size * batches - distinct
    rows. Each distinct prompt is evaluated once; items without a prompt have no results.
    """
    batches, seen = in_batches(items, prompt, length, size)
    made = T.StructType.fromDDL(results)
    out = T.StructType([*batches.drop("slot").schema, *made])
    dealt = batches.repartition("length", "batch").sortWithinPartitions("length", "batch", "slot").drop("slot")
    answers = dealt.mapInPandas(_run(evaluate, size, made.names), out).withColumnRenamed("prompt", "_prompt")
    return items.join(answers, items[prompt] == F.col("_prompt"), "left").drop("_prompt"), seen
