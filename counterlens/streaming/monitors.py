"""Streaming forms: the adaptive threshold as a keyed stateful fold, a windowed monitor, file sources and idempotent sinks (ST1-ST5)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from counterlens.functions.adaptive import AdaptiveThreshold, OrderedValues
from counterlens.sources import files

FOLDED = "stream string, seq long, tau double, retained boolean, error boolean, level double"
_NAMES = ["stream", "seq", "tau", "retained", "error", "level"]


def _rows(key: str, rows: pd.DataFrame, fold: AdaptiveThreshold) -> pd.DataFrame:
    u = rows["u"].fillna(float("inf"))
    made = [(key, int(s), *fold.step(float(x), bool(ok))) for s, x, ok in zip(rows["seq"], u, rows["ok"])]
    return pd.DataFrame(made, columns=_NAMES)


def adaptive_batch(items: DataFrame) -> DataFrame:
    """The fold over (stream, seq, u, ok), each stream in the order of seq. A missing u is infinite.

    The fold is sequential, so streams are the unit of scale; a task reads its streams row
    by row and holds a bounded summary of what it has seen.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = fold = None
        for batch in batches:
            for name, rows in batch.groupby("stream", sort=False, dropna=False):
                name = None if name != name else name
                if fold is None or name != key:
                    key, fold = name, AdaptiveThreshold()
                yield _rows(key, rows, fold)

    return items.repartition("stream").sortWithinPartitions("stream", "seq").mapInPandas(run, FOLDED)


class _Adaptive(StatefulProcessor):
    """State of a stream: the level and what decides the halvings, and the buffers of seen values by level."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "level double, turns long")
        self.seen = handle.getMapState("seen", "buffer int", "content binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, turns = self.now.get() if self.now.exists() else (None, 0)
        seen = OrderedValues(levels={k[0]: np.frombuffer(v[0]) for k, v in self.seen.iterator()}, turns=turns)
        fold = AdaptiveThreshold(level=level, seen=seen)
        for part in [pd.concat(list(rows)).sort_values("seq")]:
            yield _rows(key[0], part, fold)
        for k in seen.changed:
            self.seen.updateValue((k,), (np.array(seen.levels[k], float).tobytes(),))
        self.now.update((fold.level, seen.turns))

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = STATE_STORE):
    """Streams that start inside use this state store; the session's own setting returns afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def adaptive_stream(items: DataFrame) -> DataFrame:
    """The same over a stream; each batch is put in order, and batches must come in order.

    The state of a key is bounded as its summary is, and a batch rewrites only the buffers
    that changed. The session's state store must be one with column families (``STATE_STORE``).
    """
    return items.groupBy("stream").transformWithStateInPandas(_Adaptive(), FOLDED, "Append", "None")


class _Budget(StatefulProcessor):
    """State of a stream: how much of its budget is taken."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        part = pd.concat(list(rows)).sort_values("seq")
        part["running"] = taken + part["size"].fillna(0).astype("int64").cumsum()
        self.taken.update((int(part["running"].iloc[-1]),))
        yield part.loc[part["running"] <= self.budget, ["stream", "seq", "running"]]

    def close(self) -> None:
        pass


def budget_stream(rows: DataFrame, budget: int) -> DataFrame:
    """stream, seq, running of the rows (stream, seq, size) that come while the sizes of their stream, their own included, are within the budget.

    A row that would exceed it ends the stream's collection, as all later sums do. Batches
    must come in the order of seq; the state is one number a stream. A NULL size is 0.
    """
    return rows.groupBy("stream").transformWithStateInPandas(_Budget(budget), "stream string, seq long, running long", "Append", "None")


def budgeted(spark: SparkSession, rows: DataFrame, budget: int, batches: int = 3) -> DataFrame:
    """``rows`` played as a stream, in so many batches of rising seq, through ``budget_stream``; a repeated batch replaces itself."""
    path, out, state = (files.scratch_path(spark, n) for n in ("budget", "budget-out", "budget-state"))
    cuts = rows.approxQuantile("seq", [k / batches for k in range(1, batches)], 0.01)
    edges = [float("-inf"), *cuts, float("inf")]
    rows.limit(0).write.parquet(path)
    with state_store(spark):
        for a, b in zip(edges, edges[1:]):
            rows.where((F.col("seq") > a) & (F.col("seq") <= b)).write.mode("append").parquet(path)
            stream = budget_stream(spark.readStream.schema(rows.schema).parquet(path), budget)
            stream.writeStream.foreachBatch(once_per_batch(out)).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def coverage_monitor(decisions: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: coverage and violations by tumbling window of (ts, label, pred, abstained)."""
    bad = (F.col("label") == "UNSAFE") & (F.col("pred") == "SAFE") & ~F.col("abstained")
    grouped = decisions.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg((~F.col("abstained")).cast("double")).alias("coverage"), F.count_if(bad).alias("violations")).select(F.col("w.start").alias("start"), "n", "coverage", "violations")


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once_per_batch(path: str, key: str = "batch"):
    """A foreachBatch sink that can be repeated: each batch overwrites its own folder."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{key}={number}")

    return write
