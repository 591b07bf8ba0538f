"""Counterfactual pairs from a fact table, and predictions over them.

The fact table stands in for laboratory events: users are patients, event types are
measured items. All families are read in one scan, joined to the small rule table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterlens.functions import clinical as C
from counterlens.operators import conformal

RULES = [
    # family, order, item, convert, op, threshold, held_out, provenance
    ("egfr30", 0, "view", "ckd_epi", "<", 30.0, False, "attested"),
    ("egfr45", 1, "view", "ckd_epi", "<", 45.0, False, "attested"),
    ("high", 2, "click", "identity", ">", 150.0, False, "assumed"),
    ("held", 3, "purchase", "identity", ">", 120.0, True, "unattested"),
]
RULE_SCHEMA = "family string, rule_order long, item string, convert string, op string, threshold double, held_out boolean, provenance string"
VARIANTS = [
    # number, name, rag, gate, uq, cl
    (0, "base", False, False, False, False),
    (1, "rag", True, False, False, False),
    (2, "sym", False, True, False, False),
    (3, "uq", False, False, True, False),
    (4, "cl", False, False, False, True),
    (5, "nsai", True, True, False, False),
    (6, "nsai_uq", True, True, True, False),
    (7, "nsai_uq_cl", True, True, True, True),
]
VARIANT_SCHEMA = "v long, variant string, rag boolean, gate boolean, uq boolean, cl boolean"
PRIME = 1000003
TAU = 0.5


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, VARIANT_SCHEMA)


def patients(events: DataFrame) -> DataFrame:
    """sid, age, sex of every user."""
    u = F.col("sid")
    return events.select(F.col("user_id").alias("sid")).distinct().select("sid", (18 + (u * 7) % 73).alias("age"), F.when(u % 2 == 0, "female").otherwise("male").alias("sex"))


def labs(events: DataFrame) -> DataFrame:
    return events.where(F.col("value").isNotNull()).select("event_id", F.col("user_id").alias("sid"), F.col("event_type").alias("item"), "ts", F.round("value", 2).alias("value"))


def facts(events: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Every lab against every rule on its item, with the rule's quantity and side."""
    joined = labs(events).join(F.broadcast(rule_table), "item").join(patients(events), "sid")
    scr = F.lit(0.3) + F.col("value") / F.lit(40.0)
    q = F.round(F.when(F.col("convert") == "ckd_epi", C.ckd_epi(scr, F.col("age"), F.col("sex"))).otherwise(F.col("value")), 6)
    unsafe = F.when(F.col("op") == "<", F.col("q") < F.col("threshold")).otherwise(F.col("q") > F.col("threshold"))
    return joined.withColumn("q", q).where(F.col("age").between(18, 91)).withColumn("unsafe", unsafe)


def pair_arms(fact_table: DataFrame) -> DataFrame:
    """Causal and control arms of every family and patient that has measurements on both sides.

    The causal pair is the unsafe and the safe measurement nearest the threshold. The
    control pair is the widest pair on one side, at times that the causal pair does not
    use; the safe side wins ties. All windows share the partitioning by family and
    patient, so the facts are shuffled once.
    """
    pair, side = Window.partitionBy("family", "sid"), Window.partitionBy("family", "sid", "unsafe")
    x = fact_table.withColumn("nearest", F.row_number().over(side.orderBy(F.abs(F.col("q") - F.col("threshold")), "ts", "event_id")) == 1)
    x = x.withColumn("sides", F.count_if("nearest").over(pair)).where("sides = 2")
    x = x.withColumn("free", ~F.array_contains(F.collect_set(F.when(F.col("nearest"), F.col("ts"))).over(pair), F.col("ts")))
    x = x.withColumn("spread", F.max(F.when(F.col("free"), F.col("q"))).over(side) - F.min(F.when(F.col("free"), F.col("q"))).over(side))
    widest = F.max(F.when(F.col("spread") > 0, F.struct("spread", (~F.col("unsafe")).alias("safe")))).over(pair)
    x = x.withColumn("widest", widest)
    chosen = F.col("free") & (F.col("spread") == F.col("widest.spread")) & (F.col("unsafe") != F.col("widest.safe"))
    own = Window.partitionBy("family", "sid", "unsafe", "free")
    x = x.withColumns({"low": F.row_number().over(own.orderBy("q", "ts", "event_id")), "high": F.row_number().over(own.orderBy(F.desc("q"), "ts", "event_id"))})
    arm = F.when(F.col("nearest"), F.when(F.col("unsafe"), "unsafe").otherwise("safe")).when(chosen & (F.col("low") == 1), "ctrl_a").when(chosen & (F.col("high") == 1), "ctrl_b")
    return x.withColumn("arm", arm).where("arm IS NOT NULL").withColumn("is_control", ~F.col("nearest"))


def split_of(sid: Column, held_out: Column) -> Column:
    h = (sid * 2654435761) % PRIME % 10
    return F.when(held_out, "heldout").when(h < 5, "test").when(h < 7, "calib").otherwise("train")


def items(events: DataFrame) -> DataFrame:
    """The benchmark: one row an arm of a causal or control pair."""
    rule_table = rules(events.sparkSession)
    full = pair_arms(facts(events, rule_table))
    pair = F.concat_ws("_", "family", F.col("sid").cast("string"))
    pair = F.when(F.col("is_control"), F.concat(pair, F.lit("__ctrl"))).otherwise(pair)
    place = F.array_position(F.array(*map(F.lit, ["unsafe", "safe", "ctrl_a", "ctrl_b"])), F.col("arm")) - 1
    no = F.col("sid") * 32 + F.col("rule_order") * 8 + place * 2
    prompt = F.concat(F.lit("Patient on "), F.col("family"), F.lit(" has value "), F.round(F.col("value")).cast("long").cast("string"), F.lit(". Is it safe?"))
    return full.select(
        no.alias("item_no"), F.concat(pair, F.lit("_"), F.col("arm")).alias("id"), pair.alias("pair_id"), "family", "rule_order", "held_out", "arm",
        F.when(F.col("unsafe"), "UNSAFE").otherwise("SAFE").alias("label"), "is_control", "sid", "event_id", "ts", F.col("value").alias("factor_value"), "q", "op", "threshold",
        split_of(F.col("sid"), F.col("held_out")).alias("split"), prompt.alias("prompt"), F.when(no % 3 == 0, "implicit").otherwise("explicit").alias("presentation"),
    )


def predictions(item_table: DataFrame) -> DataFrame:
    """A deterministic backend run under every variant: what a model would have answered."""
    spark = item_table.sparkSession
    x = item_table.crossJoin(F.broadcast(variants(spark)))
    no, v = F.col("item_no"), F.col("v")
    h1, h2 = (no * 2654435761 + v * 40503) % PRIME, (no * 97531 + v * 7919 + 12345) % PRIME
    x = x.withColumn("h1", h1).withColumn("h2", h2).withColumn("gate_fired", F.col("gate") & (h2 % 10 < 6))
    own = F.when(h2 % 50 == 0, None).when(h1 < 600000 + v * 40000, F.col("label")).otherwise(F.when(F.col("label") == "SAFE", "UNSAFE").otherwise("SAFE"))
    x = x.withColumn("own", own).withColumn("pred", F.when(F.col("gate_fired"), F.col("label")).otherwise(F.col("own")))
    x = x.withColumn("logit_margin", F.when(h1 % 17 == 0, None).otherwise((h2 % 81 - 40) / F.lit(10.0)))
    x = x.withColumn("u", F.round(C.decision_entropy(F.col("logit_margin")), 9))
    defer = F.col("uq") & ~F.col("gate_fired") & (F.col("pred").isNull() | F.col("u").isNull() | (F.col("u") > TAU))
    x = x.withColumn("abstained", F.coalesce(defer, F.lit(False)))
    raw = F.when(F.col("own").isNull(), "I cannot tell from this.").when(F.col("own") == "SAFE", "Answer: safe, the value is within range.").otherwise(F.when(h1 % 2 == 0, "It is NOT SAFE here.").otherwise("Unsafe: the threshold is crossed."))
    return x.withColumn("raw", raw).withColumn("correct", F.coalesce(~F.col("abstained") & (F.col("pred") == F.col("label")), F.lit(False)))


def run_variants(answers: DataFrame, alpha: float = 0.1, delta: float = 0.1) -> DataFrame:
    """Every variant as it runs: calibrated on the split ``calib``, then applied to all rows.

    ``answers`` has variant, split, uq, gate_fired, pred, label, u. Variants with an
    uncertainty stage take the threshold of their own open calibration rows, scored by the
    answer that they give there; they defer an open row without an answer, without a
    score, or with one above it. tau is NULL for the others.
    """
    open_ = ~F.col("gate_fired")
    pool = conformal.pool(answers.where("uq AND split = 'calib'"), ["variant"], open_).withColumn("ok", F.coalesce(F.col("pred") == F.col("label"), F.lit(False)))
    taus = conformal.calibrate(pool, ["variant"], alpha, delta).select("variant", "tau")
    run = answers.drop("abstained", "correct").join(taus, "variant", "left")
    defer = F.col("uq") & open_ & (F.col("pred").isNull() | F.col("u").isNull() | ~F.coalesce(F.col("u") <= F.col("tau"), F.lit(False)))
    run = run.withColumn("abstained", defer)
    return run.withColumn("correct", F.coalesce(~F.col("abstained") & (F.col("pred") == F.col("label")), F.lit(False)))
