"""Audits of item and prediction tables: leakage, integrity, recomputation and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_between_splits(df: DataFrame, value: str, split: str, allowed: DataFrame | None = None) -> DataFrame:
    """split_a, split_b, shared: distinct values that stand in both of two splits.

    A value's splits are gathered (there are few splits), so long texts are shuffled once
    and no table is joined with itself; texts are compared by two 64-bit hashes and their
    length. ``allowed`` (split_a, split_b) pairs are left out.
    """
    text = F.col(value).cast("string")
    seen = df.where(F.col(value).isNotNull()).groupBy(F.xxhash64(text).alias("h"), F.xxhash64(F.lit("again"), text).alias("g"), F.length(text).alias("n")).agg(F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1")
    pairs = seen.select(F.posexplode("splits").alias("i", "split_a"), "splits").select("split_a", F.explode(F.slice("splits", F.col("i") + 2, F.size("splits"))).alias("split_b"))
    out = pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))
    return out.join(allowed, ["split_a", "split_b"], "left_anti") if allowed is not None else out


def pair_census(items: DataFrame, keys: Sequence[str], value: str = "factor_value") -> DataFrame:
    """Pairs by state: incomplete, complete, labels agree; control, control crosses, control equal."""
    by = items.groupBy(*keys, "pair_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("is_control", F.lit(False))).alias("control"), F.count_distinct("label").alias("labels"), F.count_distinct(value).alias("vals"))
    control = F.when(F.col("labels") != 1, "control crosses").when(F.col("vals") != 2, "control equal").otherwise("control")
    state = F.when(F.col("n") != 2, "incomplete").when(F.col("control"), control).when(F.col("labels") != 2, "labels agree").otherwise("complete")
    return by.groupBy(*keys, state.alias("state")).agg(F.count("*").alias("pairs"))


def conflicts(items: DataFrame, prompt: str, label: str, group: str) -> DataFrame:
    """Prompts that carry more than one label, by the (sorted) groups in which they stand, with their items and their share of all items."""
    by = items.groupBy(prompt).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.concat_ws("+", F.array_sort(F.collect_set(group))).alias("groups")).where("labels > 1")
    total = items.agg(F.count("*").alias("total"))
    out = by.groupBy("groups").agg(F.count("*").alias("prompts"), F.sum("n").alias("n_items"))
    return out.crossJoin(F.broadcast(total)).select(F.col("groups").alias(group), "prompts", "n_items", (F.col("n_items") / F.col("total")).alias("share"))


def varying_answers(preds: DataFrame, keys: Sequence[str], prompt: str, pred: str) -> DataFrame:
    """Prompts with more than one answer; a missing answer is an answer of its own."""
    by = preds.groupBy(*keys, prompt).agg((F.count_distinct(pred) + F.max(F.col(pred).isNull().cast("int"))).alias("answers"))
    return by.where("answers > 1").groupBy(*keys).agg(F.count("*").alias("prompts"))


def id_match(items: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """kind, n: predictions missing, extra and repeated, by one aggregation over both tables' keys."""
    sides = items.select(F.col(key).alias("k"), F.lit(1).alias("i"), F.lit(0).alias("p")).unionByName(preds.select(F.col(key).alias("k"), F.lit(0).alias("i"), F.lit(1).alias("p")))
    by = sides.groupBy("k").agg(F.sum("i").alias("i"), F.sum("p").alias("p"))
    # a row of items counts as often as it stands there
    sums = by.agg(F.sum(F.when(F.col("p") == 0, F.col("i")).otherwise(0)).alias("missing"), F.sum(F.when(F.col("i") == 0, F.col("p")).otherwise(0)).alias("extra"), F.sum(F.greatest(F.col("p") - 1, F.lit(0))).alias("repeated"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(x).alias("kind"), F.coalesce(x, F.lit(0)).alias("n")) for x in ("missing", "extra", "repeated")])))


def aligned(left: DataFrame, right: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Rows of both sides by key (left columns by name, right ones renamed as ``columns`` says); fails if either lacks a key of the other or repeats one."""
    one = left.groupBy(key).agg(F.count("*").alias("_l"), *[F.first(c).alias(c) for c in left.columns if c != key])
    two = right.groupBy(key).agg(F.count("*").alias("_r"), *[F.first(c).alias(n) for c, n in columns.items()])
    both = one.join(two, key, "full")
    whole = (F.coalesce("_l", F.lit(0)) == 1) & (F.coalesce("_r", F.lit(0)) == 1)
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("not one row on each side for "), F.col(key).cast("string"))))).drop("_l", "_r")


def unseen(items: DataFrame, train: DataFrame, prompt: str, group: str) -> DataFrame:
    """Groups of which no prompt stands in the training table."""
    known = train.select(prompt).distinct().withColumn("_seen", F.lit(True))
    by = items.join(known, prompt, "left").groupBy(group).agg(F.bool_or(F.coalesce("_seen", F.lit(False))).alias("_seen"))
    return by.where("NOT _seen").select(group)


def difference(before: DataFrame, after: DataFrame, key: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Two artifacts by key: both missing, no baseline, not re-run, identical or changed, and the change."""
    joined = before.select(*key, F.col(value).alias("_a")).join(after.select(*key, F.col(value).alias("_b")), list(key), "full")
    a, b = F.col("_a"), F.col("_b")
    status = F.when(a.isNull() & b.isNull(), "both missing").when(a.isNull(), "no baseline").when(b.isNull(), "not re-run").when(F.abs(a - b) <= tolerance, "identical").otherwise("changed")
    return joined.select(*key, status.alias("status"), (b - a).alias("delta"))


def moved(before: DataFrame, after: DataFrame, key: Sequence[str], value: str, layer: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows other than those of the last layer (of ``before``) that moved; comparable says whether both runs used as many pairs.

    Both tables have ``used``, the pairs of the run.
    """
    last = before.agg(F.max(layer).alias("_last"))
    a = before.select(*key, F.col(value).alias("_a"), F.col("used").alias("_ua"))
    b = after.select(*key, F.col(value).alias("_b"), F.col("used").alias("_ub"))
    far = a.join(b, list(key)).crossJoin(F.broadcast(last)).where((F.abs(F.col("_a") - F.col("_b")) > tolerance) & (F.col(layer) != F.col("_last")))
    return far.select(*key, (F.col("_b") - F.col("_a")).alias("change"), (F.col("_ua") == F.col("_ub")).alias("comparable"))


def recomputed(items: DataFrame, keys: Sequence[str], label: str, again: Column) -> DataFrame:
    """Rows, and rows whose label is not the one computed again."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col(label).eqNullSafe(again)).alias("wrong"))


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether two tables hold the same keys."""
    sides = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).unionByName(b.select(F.col(key).alias("k"), F.lit(2).alias("s")))
    by = sides.groupBy("k").agg(F.count_distinct("s").alias("n"))
    return by.agg((F.count_if(F.col("n") < 2) == 0).alias("equal"))


def from_prompt(items: DataFrame, prompt: str, number: str, quantity: Column, op: str = "op", threshold: str = "threshold") -> DataFrame:
    """``items`` with shown, decimals, derived and relabelled: what the last line of a prompt states, and the label that it implies.

    ``number`` is a pattern whose first group is the stated number; ``quantity`` an expression
    over shown and columns of ``items``. The label compares with the rule's own threshold. All
    are NULL where the last line states nothing: lines before it may hold other numbers.
    """
    last = F.element_at(F.split(F.trim(F.col(prompt)), "\n"), -1)
    stated = F.nullif(F.regexp_extract(last, number, 1), F.lit(""))
    x = items.withColumns({"shown": stated.cast("double"), "decimals": F.length(F.regexp_extract(stated, r"[.](\d+)$", 1))})
    x = x.withColumn("derived", quantity)
    unsafe = F.when(F.col(op) == "<", F.col("derived") < F.col(threshold)).when(F.col(op) == ">", F.col("derived") > F.col(threshold))
    return x.withColumn("relabelled", F.when(unsafe, "UNSAFE").when(~unsafe, "SAFE"))


def rederived(items: DataFrame, keys: Sequence[str], raw: str = "factor_value", label: str = "label") -> DataFrame:
    """Of ``from_prompt``: n, unread, value_off (the raw value does not round to the one shown), label_off, by ``keys``."""
    off = F.abs(F.col(raw) - F.col("shown")) > 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("shown").isNull()).alias("unread"), F.count_if(off).alias("value_off"), F.count_if(F.col("relabelled") != F.col(label)).alias("label_off"))


def decisions_rederived(preds: DataFrame, keys: Sequence[str], own: Column, uncertainty: Column, tau: str = "tau", defers: str = "uq") -> DataFrame:
    """Of predictions whether each part follows from the others: n, entropy_off, gate_off, pred_off, abstained_off, by ``keys``.

    Entropy is that of the margin, missing together with it. Where the gate fired, its
    verdict (violated) must be the rule's label; the prediction is the gate's or the
    model's ``own`` answer; deferred is, of variants that may, an open row without an
    answer, without a score, or with one above tau.
    """
    verdict = F.when(F.col("violated"), "UNSAFE").otherwise("SAFE")
    want = F.when(F.col("gate_fired"), verdict).otherwise(own)
    defer = F.col(defers) & ~F.col("gate_fired") & (want.isNull() | ~F.coalesce(uncertainty <= F.col(tau), F.lit(False)))
    entropy_off = ~F.coalesce(F.abs(uncertainty - F.col("u")) < 1e-6, uncertainty.isNull() & F.col("u").isNull())
    return preds.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(entropy_off).alias("entropy_off"),
        F.count_if(F.col("gate_fired") & (verdict != F.col("label"))).alias("gate_off"),
        F.count_if(~F.col("pred").eqNullSafe(want)).alias("pred_off"),
        F.count_if(F.col("abstained") != defer).alias("abstained_off"),
    )
