"""Accuracy, uncertainty, tests and agreement: the operators on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.functions import binomial, clinical
from counterlens.operators import agreement, cohort, conformal, inference, metrics, ordered, sampling, uncertainty
from counterlens.plans.registry import Tables, call

V = ["variant"]
ALPHA = 0.45  # an error rate that the backend of the test tables can meet


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def wrong():
    """Whether the own answer is not the label."""
    return ~F.coalesce(F.col("own") == F.col("label"), F.lit(False))


@call
def a01_strict_accuracy(t: Tables):
    return rounded(metrics.item_rates(t["preds"], V).select("variant", "n", "accuracy"), "accuracy")


@call
def a02_selective_accuracy(t: Tables):
    return rounded(metrics.item_rates(t["preds"], V).select("variant", "selective_accuracy"), "selective_accuracy")


@call
def a03_violation_rate(t: Tables):
    return rounded(metrics.item_rates(t["preds"], V).select("variant", "n_unsafe", "violation_rate"), "violation_rate")


@call
def a04_rates(t: Tables):
    fired = t["preds"].groupBy("variant").agg(metrics.rate("gate_fired").alias("gate_fired_rate"))
    return rounded(metrics.item_rates(t["preds"], V).select("variant", "abstention_rate", "coverage", "unparsable_rate").join(fired, "variant"), "abstention_rate", "coverage", "unparsable_rate", "gate_fired_rate")


@call
def a05_causal_consistency(t: Tables):
    return rounded(metrics.pair_rates(t["preds"], ["variant", "family"]).select("variant", "family", "n_pairs", "causal_consistency"), "causal_consistency")


@call
def a06_causal_flip_rate(t: Tables):
    return rounded(metrics.pair_rates(t["preds"], V).select("variant", "n_answered", "causal_flip_rate").where("n_answered > 0"), "causal_flip_rate")


@call
def a07_spurious_flip_rate(t: Tables):
    return rounded(metrics.pair_rates(t["preds"], ["variant", "split"]).select("variant", "split", "n_control_pairs", "spurious_flip_rate"), "spurious_flip_rate")


@call
def a08_discrimination(t: Tables):
    return rounded(metrics.pair_rates(t["preds"], V).select("variant", "discrimination"), "discrimination")


@call
def a10_conditional_coverage(t: Tables):
    return rounded(metrics.conditional_coverage(t["preds"], V, ["family", "label", "presentation", "gate_fired"]), "coverage", "selective_accuracy", "violation_rate")


@call
def a11_coverage_gap(t: Tables):
    covered = metrics.conditional_coverage(t["preds"], V, ["family", "label", "presentation", "gate_fired"])
    return rounded(metrics.coverage_gap(covered, V), "lowest", "highest", "gap")


@call
def a12_grouped_pooled(t: Tables):
    return rounded(metrics.grouped_pairs(t["preds"], V, "family").withColumnRenamed("control", "ctrl"), "consistency", "flip_rate")


@call
def a13_constant_baseline(t: Tables):
    return rounded(metrics.constant_baseline(t["preds"], V), "baseline_accuracy", "response_bias", "response_gold")


@call
def a14_auroc(t: Tables):
    return rounded(uncertainty.auroc(t["preds"], "u", wrong(), V), "auroc")


@call
def a15_ece(t: Tables):
    return rounded(uncertainty.ece(t["preds"], F.lit(1.0) / (F.lit(1.0) + F.exp(-F.abs("logit_margin"))), ~wrong(), V), "ece")


def _curve(t: Tables) -> DataFrame:
    return uncertainty.risk_coverage(t["preds"].where("NOT gate_fired"), "u", wrong(), V)


@call
def a16_risk_coverage(t: Tables):
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold")).alias("threshold")
    return rounded(_curve(t).select("variant", finite, "kept", "coverage", "error"), "coverage", "error")


@call
def a17_aurc_prefixes(t: Tables):
    return rounded(uncertainty.aurc_prefixes(t["preds"], "u", ["item_no"], wrong(), V), "aurc")


@call
def a18_aurc_grid(t: Tables):
    return rounded(uncertainty.aurc_grid(_curve(t), V), "aurc")


@call
def a19_fraction_grid(t: Tables):
    return rounded(uncertainty.fraction_grid(t["preds"], "u", ["item_no"], wrong(), V), "risk")


@call
def a20_operating_points(t: Tables):
    return rounded(uncertainty.operating_points(_curve(t), [1, 0.9, 0.75, 0.5, 0.25, 0.1, 0.05, 0.01], V), "coverage", "error")


@call
def a20_reach(t: Tables):
    return rounded(uncertainty.reach(_curve(t), V, 0.01, 0.3), "floor_error", "reach")


@call
def a21_point_at_tau(t: Tables):
    """A threshold on the curve, one under its first point, and one that retains nothing."""
    taus = t["preds"].select("variant", F.explode(F.array(*[F.lit(x) for x in (0.5, -1.0, float("-inf"))])).alias("tau")).distinct()
    out = uncertainty.point_at(_curve(t), taus, V).withColumn("tau", F.when(F.col("tau") > float("-inf"), F.col("tau")))
    return rounded(out, "coverage", "error")


def _ratings(t: Tables) -> DataFrame:
    """Three raters of every labelled document; one in eleven of the third's ratings is missing."""
    d, q = F.col("doc_id"), F.col("quality")
    values = {"r1": 1 + q + d % 3, "r2": 1 + q + F.when(d % 4 == 0, (d + 1) % 3).otherwise(d % 3), "r3": F.when(d % 11 != 0, 1 + q + F.when(d % 5 == 0, 1).otherwise(d % 3))}
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("rater"), v.cast("long").alias("value")) for r, v in values.items()]))
    return t["labels"].select(d.alias("unit"), each)


@call
def a45_krippendorff_nominal(t: Tables):
    return rounded(agreement.krippendorff(_ratings(t)), "alpha")


@call
def a45_krippendorff_ordinal(t: Tables):
    return rounded(agreement.krippendorff(_ratings(t), level="ordinal"), "alpha")


@call
def a46_fleiss_kappa(t: Tables):
    return rounded(agreement.fleiss(_ratings(t)), "kappa")


@call
def a47_intra_rater(t: Tables):
    """Odd documents repeat the even ones before them; a rating of at least 3 passes its feature (ten documents)."""
    key = F.concat((F.col("unit") - F.col("unit") % 2).cast("string"), F.when(F.col("unit") % 2 == 1, "R").otherwise(""))
    repeats = rounded(agreement.intra_rater(_ratings(t), key, ["rater"]), "agreement")
    passed = agreement.pass_rate(_ratings(t).where("value IS NOT NULL").withColumn("feature", F.floor(F.col("unit") / 10)), "feature", F.col("value") >= 3)
    return repeats.crossJoin(F.broadcast(rounded(passed, "pass_rate", "mean_accepted")))


# ---- thresholds
def _pool(t: Tables) -> DataFrame:
    return conformal.pool(t["preds"].where("split = 'calib'"), V, ~F.col("gate_fired")).withColumns({"ok": ~wrong(), "seq": F.col("item_no")})


def _errors(t: Tables) -> DataFrame:
    """n and k, the rows and wrong rows of every variant, family and split, and of those of every patient."""
    p = t["preds"].withColumn("_wrong", wrong().cast("long"))
    by = lambda *keys: p.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_wrong").alias("k")).select("n", "k")
    return by("variant", "family", "split").unionByName(by("variant", "sid")).unionByName(by("variant")).where("k < n").distinct()


@call
def u01_binomial_tail(t: Tables):
    """P(X <= k) of the error counts of groups of all sizes."""
    tails = _errors(t).withColumn("tail", F.round(binomial.tail_of("k", "n", F.lit(0.4)), 9))
    return tails.withColumn("certifies", F.col("tail") <= 0.1)


@call
def u01_upper_limits(t: Tables):
    """The rate at which so few errors, or fewer, have a chance of 0.1; checked by that chance."""
    limits = _errors(t).withColumn("upper", binomial.upper_limit("k", "n", F.lit(0.1)))
    return limits.select("n", "k", F.round(binomial.tail_of("k", "n", F.col("upper")), 6).alias("chance"), (F.col("upper") >= F.col("k") / F.col("n")).alias("above"))


@call
def u02_min_certifiable_n(t: Tables):
    """Whether the calibration rows of each variant and family are enough for a rate and a confidence."""
    by = t["preds"].where("split = 'calib'").groupBy("variant", "family").agg(F.count("*").alias("rows"))
    asked = t.spark.createDataFrame([(a, d, conformal.min_certifiable_n(a, d)) for a in (0.2, 0.1, 0.05) for d in (0.2, 0.1, 0.05)], "alpha double, delta double, least long")
    return by.crossJoin(F.broadcast(asked)).select("variant", "family", "alpha", "delta", "least", (F.col("rows") >= F.col("least")).alias("enough"))


@call
def u03_conformal_threshold(t: Tables):
    found = t["variants"].select("variant").join(conformal.calibrate(_pool(t), V, alpha=ALPHA), "variant", "left")
    found = found.na.fill({"retained": 0, "certifiable": False})
    return found.select("variant", F.when(F.col("certifiable"), F.col("tau")).alias("tau"), "retained", "certifiable")


@call
def u04_legacy_threshold(t: Tables):
    rows = t["preds"].where("split = 'calib' AND u IS NOT NULL").withColumns({"ok": ~wrong(), "seq": F.col("item_no")})
    return conformal.calibrate(rows, V, alpha=0.3, rule="legacy")


@call
def u05_calibration_diagnostics(t: Tables):
    pool = _pool(t)
    out = conformal.diagnostics(pool, conformal.calibrate(pool, V, alpha=ALPHA), V)
    return rounded(out.select("variant", "n", "retained", "errors", "coverage", "selective_error", "certifiable"), "coverage", "selective_error")


@call
def u17_calibration_pool(t: Tables):
    return conformal.pool(t["preds"].where("split = 'calib'"), V, ~F.col("gate_fired")).groupBy("variant", "rule").agg(F.count("*").alias("n"))


@call
def x02_variant_run(t: Tables):
    """Every variant calibrated on its calibration split, then run on the others with that threshold."""
    return cohort.run_variants(t["preds"], alpha=ALPHA).where("split = 'test'").select("variant", "id", "pred", "abstained", "gate_fired", F.when(F.col("tau") > float("-inf"), F.col("tau")).alias("tau"))


# ---- tests and bootstraps
def _paired(t: Tables) -> DataFrame:
    return inference.against(t["preds"], "item_no", "variant", "base", "correct")


@call
def u06_bootstrap_interval(t: Tables):
    return rounded(inference.mean_interval(t["preds"], F.col("correct"), V).select("variant", "lo", "hi"), "lo", "hi")


@call
def u07_paired_bootstrap(t: Tables):
    """Area of the margin against that of the decision entropy scaled by its hash, on the same rows."""
    rows = t["preds"].withColumn("other", F.round(F.col("u") + (F.col("h1") % 50) / 100.0, 2))
    return rounded(inference.paired_delta(rows, "u", "other", wrong(), V), "auroc_a", "auroc_b", "delta", "lo", "hi", "p")


@call
def u08_auroc_bootstrap(t: Tables):
    return rounded(inference.auroc_interval(t["preds"], "u", wrong(), V), "auroc", "lo", "hi")


@call
def u09_two_sample_bootstrap(t: Tables):
    pairs = metrics.pairs(t["preds"], V).where("answered")
    hits = lambda c: (F.count_if((F.col("control") == c) & F.col("flipped")), F.count_if(F.col("control") == c))
    (k1, n1), (k2, n2) = hits(False), hits(True)
    return rounded(inference.difference_interval(pairs.groupBy("variant").agg(k1.alias("k1"), n1.alias("n1"), k2.alias("k2"), n2.alias("n2")), V), "difference", "lo", "hi")


@call
def u10_cluster_bootstrap(t: Tables):
    return rounded(inference.cluster_interval(t["preds"], "prompt", F.col("correct"), V), "lo", "hi")


def _mcnemar(t: Tables) -> DataFrame:
    return inference.mcnemar(_paired(t), F.col("before"), F.col("after"), V)


@call
def u11_mcnemar(t: Tables):
    return rounded(_mcnemar(t), "p_value")


@call
def u12_holm(t: Tables):
    tests = _mcnemar(t).select("variant", F.round("p_value", 12).alias("p"))
    return rounded(inference.holm(tests, "variant", "p"), "p", "p_holm")


@call
def u14_uncertainty_signals(t: Tables):
    """The signals of every row; a missing one counts as infinitely unsure."""
    p, m = t["preds"], F.col("logit_margin")
    entropy = clinical.decision_entropy(m)
    unsure = lambda x: F.coalesce(x, F.lit(float("inf")))
    return p.select("item_no", "variant", F.round(entropy, 6).alias("decision_entropy"), (unsure(entropy) == float("inf")).alias("missing"), (-F.abs(m)).alias("neg_margin"), (-m).alias("neg_logprob"))


@call
def u18_option_entropy(t: Tables):
    """Entropy and largest probability of four options, from their logits, row by row."""
    z = F.array(*[((F.col("item_no") * 31 + i * 17) % 41) / 10.0 for i in range(4)])
    rows = t["items"].select("item_no", z.alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    p = rows.select("item_no", F.transform("e", lambda x: x / total).alias("p"))
    entropy = F.aggregate("p", F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return p.select("item_no", F.round(entropy, 6).alias("option_entropy"), F.round(F.array_max("p"), 6).alias("top_prob"))


@call
def u19_grouped_folds(t: Tables):
    return sampling.grouped_folds(t["items"], "pair_id", 5).withColumnRenamed("fold", "fold_no")


# ---- orders
@call
def w03_running_errors(t: Tables):
    rows = t["preds"].select("variant", "item_no", (~F.col("correct")).cast("long").alias("bad"))
    return ordered.running(rows, V, ["item_no"], {"errors": "bad"}).drop("bad")


@call
def w04_tie_blocks(t: Tables):
    blocks = uncertainty.average_ranks(uncertainty.cells(t["preds"].where("u IS NOT NULL"), "u", wrong(), V), V)
    return blocks.select("variant", F.col("score").alias("u"), (F.col("avg_rank") + (F.col("n") - 1) / 2).cast("long").alias("last_index"))


@call
def w05_average_rank(t: Tables):
    rows = t["preds"].where("u IS NOT NULL")
    ranks = uncertainty.average_ranks(uncertainty.cells(rows, "u", wrong(), V), V)
    return rows.join(ranks.withColumnRenamed("score", "u"), ["variant", "u"]).select("variant", "item_no", "avg_rank")


@call
def w06_prefix_mean(t: Tables):
    rows = t["preds"].select("variant", "item_no", F.col("correct").cast("long").alias("ok"), F.lit(1).cast("long").alias("one"))
    return ordered.running(rows, V, ["item_no"], {"k": "ok", "n": "one"}).select("variant", "item_no", F.round(F.col("k") / F.col("n"), 9).alias("m"))


@call
def w10_top_fraction(t: Tables):
    """Place and share of rows in the order of a score, as for the top part of a ranking."""
    rows = t["documents"].select("doc_id", "lang", "n_chars", F.lit(1).cast("long").alias("one"))
    placed = ordered.running(rows, ["lang"], ["n_chars", "doc_id"], {"place": "one"}, total="rows")
    return placed.select("doc_id", "lang", (F.col("place") - 1).alias("place"), F.round(F.coalesce(F.try_divide(F.col("place") - 1, F.col("rows") - 1), F.lit(0.0)), 9).alias("share"))


@call
def w13_ladder_steps(t: Tables):
    by = t["preds"].groupBy("v", "variant").agg(metrics.rate("correct").alias("acc"))
    return rounded(metrics.steps(by, "variant", "v", "acc").withColumnRenamed("next", "next_variant"), "step")


@call
def a51_pivot_delta(t: Tables):
    by = metrics.item_rates(t["preds"], V).select("variant", F.col("accuracy").alias("acc"), F.col("coverage").alias("cov"))
    return rounded(metrics.against_base(by, "variant", "base", ["acc", "cov"]), "acc", "cov", "d_acc", "d_cov")


@call
def a49_answer_census(t: Tables):
    """By variant and split: non-answers, margins whose sign agrees with the text, entropies that recompute, answers without a margin."""
    said, m = F.col("own").isNotNull(), F.col("logit_margin")
    read = said & m.isNotNull() & (m != 0)
    recomputed = read & F.col("u").isNotNull()
    agrees = F.abs(F.col("u") - (F.ln(1 + F.exp(-F.abs(m))) + F.abs(m) * (1 - 1 / (1 + F.exp(-F.abs(m)))))) < 1e-6
    lost = said & m.isNull()
    by = t["preds"].groupBy("variant", "split").agg(
        F.count("*").alias("n"),
        metrics.rate(~said).alias("non_answer"),
        F.count_if(read).alias("with_margin"),
        F.count_if(read & ((m > 0) == (F.col("own") == "SAFE"))).alias("agree"),
        F.count_if(recomputed).alias("recomputed"),
        F.count_if(recomputed & agrees).alias("recomputed_equal"),
        F.count_if(lost).alias("no_margin"),
        F.count_if(lost & F.col("abstained") & ~F.col("gate_fired")).alias("deferred_for_it"),
    )
    return rounded(by, "non_answer")
