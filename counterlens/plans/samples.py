"""Inputs that the tables at hand do not hold, derived from them by fixed arithmetic: notes, activations, effects, a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.plans.registry import Tables


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _hundredths(n: Column) -> Column:
    return _text(F.floor(n / 100), ".", F.lpad((n % 100).cast("string"), 2, "0"))


def notes(t: Tables) -> DataFrame:
    """A clinical note of every lab, on one of four drugs, with what it states as columns; every sixth states two creatinines."""
    n = F.col("event_id")
    x = t["labs"].join(t["patients"], "sid").withColumns({"cr": 30 + F.floor(F.col("value") * 100 / 40), "umol": 30 + n % 400, "qt": 300 + n % 250, "hr": 40 + n % 100, "kg": 45 + n % 60, "cm": 150 + n % 45})
    x = x.withColumns({"bil": 5 + n % 40, "alb": 20 + n % 25, "inr10": 10 + n % 20, "a": 1 + n % 3, "e": 1 + F.floor(n / 3) % 3})
    who = _text("A ", F.col("age"), "-year-old ", F.when(F.col("sex") == "female", "woman").otherwise("man"))
    tenths = lambda c: _text(F.floor(F.col(c) / 10), ".", F.col(c) % 10)
    ascites = F.element_at(F.array(*map(F.lit, ["No ascites", "Mild ascites", "Tense ascites"])), F.col("a").cast("int"))
    enceph = F.element_at(F.array(*map(F.lit, ["no encephalopathy", "grade 2 encephalopathy", "grade 4 encephalopathy"])), F.col("e").cast("int"))
    forms = [
        _text(who, " takes metformin. Serum creatinine was ", _hundredths(F.col("cr")), " mg/dL."),
        _text(who, " is on metformin. Creatinine ", F.col("umol"), " umol/L today."),
        _text(who, " is given ondansetron. QT interval ", F.col("qt"), " ms, heart rate ", F.col("hr"), " bpm."),
        _text(who, " is on nitrofurantoin. Cr ", _hundredths(F.col("cr")), " mg/dL. Weight ", F.col("kg"), " kg, height ", F.col("cm"), " cm."),
        _text(who, " with cirrhosis is on apixaban. Bilirubin ", tenths("bil"), " mg/dL, albumin ", tenths("alb"), " g/dL. INR ", tenths("inr10"), ". ", ascites, "; ", enceph, "."),
        _text("Takes metformin; creatinine 1.2 mg/dL, then creatinine 2.9 mg/dL. She saw her doctor."),
    ]
    kind = (n % 6).cast("int")
    return x.withColumn("kind", kind).withColumn("note", F.element_at(F.array(*forms), kind + 1)).withColumn("label", F.when(n % 5 < 3, "UNSAFE").otherwise("SAFE"))


def vignettes(t: Tables) -> DataFrame:
    """A short case of every lab that states one fact for one drug, some of them by denying it."""
    n = F.col("event_id")
    odd = lambda yes, no: F.when(F.floor(n / 5) % 2 == 1, yes).otherwise(no)
    who = _text("A ", 20 + n % 60, "-year-old woman takes ")
    forms = [
        _text(who, "metformin. eGFR is ", 20 + n % 60, "."),
        _text(who, "spironolactone. Her potassium is 5.", n % 9, "."),
        _text(who, "warfarin. INR is 2.", n % 10, "."),
        F.concat(who, odd(F.lit("isotretinoin and is 12 weeks pregnant."), F.lit("isotretinoin and is not pregnant."))),
        F.concat(who, odd(F.lit("propranolol, with severe asthma."), F.lit("propranolol, with no history of asthma."))),
    ]
    return t["labs"].select("event_id", (n % 5).cast("int").alias("kind"), F.element_at(F.array(*forms), (n % 5 + 1).cast("int")).alias("vignette"))


RULES = [("renal", "metformin", "egfr", "<", 30.0), ("potassium", "spironolactone", "potassium", ">", 5.5), ("inr", "warfarin", "inr", ">", 2.5), ("pregnancy", "isotretinoin", "pregnant", "==", 1.0), ("asthma", "propranolol", "severe_asthma", "==", 1.0)]


def activations(t: Tables, features: int = 12) -> DataFrame:
    """event_id, feature, x of the features that fire on an event; its type is its concept."""
    e, f = F.col("event_id"), F.col("feature")
    rows = t["events"].select("event_id", F.col("event_type").alias("concept"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(features - 1).cast("long"))).alias("feature"))
    fires = (e * (f + 7) * 2654435761) % 1000003 % (4 + f) == 0
    return rows.where(fires).withColumn("x", F.lit(0.1) + (e * (f + 3) * 31 % 101) / 50.0)


def effects(t: Tables) -> DataFrame:
    """pair_id, layer, alpha, delta, control, shuffled of an intervention on every causal pair, and the gap of the pair without any."""
    h = t["items"].where("NOT is_control").groupBy("pair_id").agg((F.min("item_no") * 2654435761 % 1000003).alias("h"))
    grid = h.withColumn("layer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (-1.0, -0.5, 0.5, 1.0)])))
    return grid.select(
        "pair_id", "layer", "alpha", ((F.col("h") % 200 - 100) / 50.0 * F.col("alpha") + F.col("layer") / 10.0).alias("delta"),
        ((F.col("h") % 90 - 45) / 60.0).alias("control"), ((F.col("h") % 50 - 25) / 70.0).alias("shuffled"), ((F.col("h") % 300 - 120) / 80.0).alias("gap"),
    )


def sweep(t: Tables) -> DataFrame:
    """run, layer, alpha, pair_id, label, margin, margin_rand of every causal item, steered at five layers; the first run has no positive doses."""
    h, a, toward = F.col("item_no") * 2654435761 % 1000003, F.col("alpha"), F.when(F.col("label") == "SAFE", 1.0).otherwise(-1.0)
    grid = t["items"].where("NOT is_control").withColumn("layer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (-1.0, -0.5, 0.0, 0.5, 1.0)])))
    margin = (h % 200 - 100) / 50.0 + a * (F.col("layer") - 1) * 0.5 * toward
    rows = grid.select("layer", "alpha", "pair_id", "label", margin.alias("margin"), ((h % 200 - 100) / 50.0 + a * (h % 7 - 3) * 0.25).alias("margin_rand"))
    return rows.withColumn("run", F.explode(F.when(a <= 0, F.array(F.lit("baseline"), F.lit("rerun"))).otherwise(F.array(F.lit("rerun")))))


def token_scores(t: Tables) -> tuple[DataFrame, ...]:
    """Items (users), what their tokens (events) give each concept, and the concepts that decide, are present, and can be expressed."""
    active = activations(t)
    stands = F.element_at(F.array(*[F.lit(c) for c in ("view", "click", "signup", "error")]), (F.col("feature") % 4 + 1).cast("int"))
    users = t["events"].select("event_id", F.col("user_id").alias("item"), F.col("event_type").alias("concept"))
    scores = active.drop("concept").join(users.drop("concept"), "event_id").select("item", F.col("event_id").alias("token"), stands.alias("concept"), "x")
    items = users.select("item", (F.col("item") % 4).alias("family")).distinct()
    decisive = t.spark.createDataFrame([(0, "view"), (0, "click"), (1, "purchase"), (2, "signup"), (2, "purchase")], "family long, concept string")
    expressible = t.spark.createDataFrame([("view",), ("click",), ("signup",), ("error",)], "concept string")
    return scores, items, decisive, users.select("item", "concept"), expressible


def graph_claims(t: Tables, by_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """Curated claims and an ontology's, from parts: brands are drugs, types findings, names families and other findings.

    Their keys are shared by some parts each, or ``by_size`` by all parts of one of seven classes of sizes.
    """
    k, p = F.col("p_partkey"), t["part"]
    key = F.concat(F.lit("k"), (F.col("p_size") % 7 if by_size else F.floor(k / 11)).cast("string"))
    curated = p.where(k % 3 == 0).select(F.col("p_brand").alias("drug"), F.concat(F.lit("F:"), "p_type").alias("finding"), F.col("p_name").alias("family"), F.array(F.lower("p_type"), key).alias("atoms"))
    rel = F.element_at(F.array(*map(F.lit, ["CONTRAINDICATED_WITH", "HAS_MECHANISM", "HAS_PHYSIOLOGIC_EFFECT", "MAY_TREAT"])), (F.floor(k / 3) % 4 + 1).cast("int"))
    target = F.when(k % 35 == 1, F.concat(F.lit("F:"), "p_type")).otherwise(F.concat(F.lit("T:"), "p_name"))
    return curated, p.where(k % 3 != 0).select(F.col("p_brand").alias("drug"), target.alias("target"), rel.alias("rel"), F.array(key).alias("atoms"))


def label_texts(t: Tables) -> DataFrame:
    """drug, section, seq, text: sources as drugs, languages as sections, of which each document is a part."""
    return t["documents"].where("text IS NOT NULL").select(F.col("source").alias("drug"), F.col("lang").alias("section"), F.col("doc_id").alias("seq"), "text")


SPECS = [
    # order, family, drug, pattern, sections, kind, rules_value, known_trap
    (0, "ly_words", "src1", r"\b(\w+ly)\b", ["en"], "qualitative", None, False),
    (1, "numbers", "src2", r"([0-9]{2})", ["en", "fr"], "numeric", 20.0, False),
    (2, "anywhere", "src3", r"([0-9]+)", [], "numeric", 1.0, False),
    (3, "trap", "src4", r"(zzzz)", ["en"], "numeric", 5.0, True),
    (4, "absent", "src5", r"(zzzz)", ["de"], "numeric", 5.0, False),
    (5, "no_label", "none", r"(x)", ["en"], "numeric", 5.0, False),
    (6, "the_words", "src6", r"\b(the\w*)", ["fr", "en"], "qualitative", None, False),
    (7, "the_again", "src7", r"\b(an\w*)", ["en"], "qualitative", None, False),
]
SPEC_SCHEMA = "order int, family string, drug string, pattern string, sections array<string>, kind string, rules_value double, known_trap boolean"
CONCEPTS = {
    # concept: synonyms, variants
    "definite": (["the", "of", "those things"], ["th"]),
    "joined": (["and", "with"], ["hand"]),
    "single": (["an"], []),
    "letters": ([], ["zq"]),
}
FAMILIES = [
    # family, explicit, implicit
    ("egfr30", "A patient has an eGFR of {value}. The team proposes metformin.", "The creatinine of a patient has reached {value}. The team proposes metformin."),
    ("egfr45", "A patient has an eGFR of {value}. The team proposes to start metformin.", None),
    ("high", "The value stands at {value}. The team proposes a double dose.", "The last report reads {value}. The team proposes a double dose."),
    ("held", "The count is {value}.", None),
]
