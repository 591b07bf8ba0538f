"""Facts from clinical text, rules over them, and gates that decide or decline.

Facts are Columns over a text column. A fact that the text does not settle is NULL, and a
gate that lacks one declines. All patterns are written by the grammar of ``statements``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions import clinical, spans
from counterlens.functions import statements as S

FACTS = {
    "egfr": [S.stated("eGFR|estimated GFR", words=2)],
    "potassium": [S.stated("potassium", words=2)],
    "inr": [S.stated("INR", words=2)],
    "qtc": [S.stated("QTc", words=2)],
    "age": [r"(?i)(?<![\d.])(\d{1,3})[\s-]+years?[\s-]+old\b"],
}
#: States by what affirms and what denies them.
STATES = {
    "pregnant": (r"(?i)(?<!not )\bpregnant\b(?! women)", r"(?i)\bnot\b(?:\W+\w+)?\W+pregnant\b|\bnegative\W+(?:\w+\W+)?pregnancy\b|\b(?:after|post)[\s-]*menopaus"),
    "severe_asthma": (S.graded_finding("asthma", ["severe", "brittle", "life-threatening"], apart=1), S.denied("asthma|airway disease|lung disease")),
    "clarithromycin": (r"(?i)\bclarithromycin\b", r"(?i)\b(?:amoxicillin|doxycycline|cefalexin|takes nothing else|no other (?:regular )?(?:drug|medicine|medication)s?)\b"),
}
AGE = [r"(?i)(?<![\d.])(\d{1,3}(?:\.\d+)?)[\s-]*(?:years?|yrs?|y)[\s-]*(?:old|of age|o)\b", S.stated("aged|age", words=1)]
# English words that tell a person's sex.
SEX_WORDS = {"male": "man|male|boy|gentleman|father|he|his|him|mr", "female": "woman|female|girl|lady|mother|she|her|hers|mrs"}
QT = [S.stated("QT interval|QT duration|QT time|QT", "ms|msec|milliseconds")]
HEART_RATE = [S.stated("heart rate|pulse rate|pulse|HR", "bpm|beats/min|/min|beats per minute"), S.bare("bpm|beats/min|beats per minute")]
WEIGHT = [S.stated("weight|weighs|weighing|body mass", "kg|kilograms", needs_unit=True), S.bare("kg|kilograms")]
HEIGHT = [S.stated("height|tall", "cm|centimetres|centimeters", needs_unit=True), S.bare("cm|centimetres|centimeters", r"1\d{2}")]
BILIRUBIN = [S.stated("bilirubin", "mg/dl")]
ALBUMIN = [S.stated("albumin", "g/dl")]
INR = [S.stated("INR|international normalised ratio|international normalized ratio")]
ASCITES = {3: S.graded_finding("ascites", ["moderate", "large", "tense", "gross", "marked", "severe"]), 2: S.graded_finding("ascites", ["mild", "small", "slight", "minimal", "trace"]), 1: S.denied("ascites")}
_GRADE = lambda *n: S.graded_finding("encephalopathy", [f"grade {x}" for x in n], apart=1)
ENCEPHALOPATHY = {3: _GRADE("3", "4", "III", "IV"), 2: _GRADE("1", "2", "I", "II"), 1: S.denied("encephalopathy")}
# Thresholds of the four rules, and names of the quantities that a note must not state.
THRESHOLDS = {"metformin": 30.0, "ondansetron": 500.0, "nitrofurantoin": 60.0, "apixaban": 10.0}
FILTRATION = "egfr|gfr|glomerular filtration rate|glomerular filtration|creatinine clearance|crcl|ccr"
DERIVED = {"eGFR": FILTRATION, "CrCl": FILTRATION, "QTc": "qtc|corrected qt", "Child-Pugh score": "child pugh|child-pugh|ctp"}


def number(text: Column, patterns: str | Sequence[str]) -> Column:
    """What the first pattern that matches captured, as a number; NULL if none does."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") for p in patterns])


def graded(text: Column, grades: dict[int, str]) -> Column:
    """The first grade whose pattern matches."""
    return reduce(lambda out, g: out.when(text.rlike(g[1]), g[0]), list(grades.items())[1:], F.when(text.rlike(next(iter(grades.values()))), next(iter(grades))))


def answer(text: Column) -> Column:
    """SAFE or UNSAFE by the first decision word of a text; NULL without one."""
    word = F.upper(F.regexp_extract(text, r"(?i)\b(UNSAFE|NOT SAFE|CONTRAINDICATED|SAFE)\b", 1))
    return F.when(word == "SAFE", "SAFE").when(word != "", "UNSAFE")


def option(text: Column, labels: Sequence[str]) -> Column:
    """The first option letter that stands alone; for labels that are words, the one that stands earliest in the text."""
    if all(len(x) == 1 and x.isalpha() for x in labels):
        return F.nullif(F.regexp_extract(text, r"\b([" + "".join(labels) + r"])\b", 1), F.lit(""))
    low = F.lower(text)
    quote = lambda x: "".join(c if c.isalnum() or c == " " else "\\" + c for c in x.lower())
    at = [F.nullif(F.regexp_instr(low, F.lit(rf"\b{quote(x)}\b")), F.lit(0)) for x in labels]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.coalesce(*[F.when(p == first, x) for p, x in zip(at, labels)])


def facts(text: Column) -> dict[str, Column]:
    """Stated numbers and states by name; of a state the affirming pattern is asked first."""
    found = {name: number(text, p) for name, p in FACTS.items()}
    return found | {name: F.when(text.rlike(yes), True).when(text.rlike(no), False) for name, (yes, no) in STATES.items()}


def compare(op: Column, value: Column, threshold: Column) -> Column:
    """value op threshold for <, > and ==; NULL where the value is missing or the operator is none of them."""
    return F.when(op == "<", value < threshold).when(op == ">", value > threshold).when(op == "==", value == threshold)


def rule_gate(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str, str, float]]) -> DataFrame:
    """``df`` with rule and violated: of (name, drug, fact, op, threshold) rules the first whose drug is named and whose fact is stated.

    Both are NULL where no rule applies. States compare as 0 and 1.
    """
    found = {k: v.cast("double") for k, v in facts(F.col(text)).items()}
    low = F.lower(text)
    named, judged = [], []
    for name, drug, fact, op, threshold in rules:
        applies = low.contains(drug.lower()) & found[fact].isNotNull()
        named.append(F.when(applies, name))
        judged.append(F.when(applies, compare(F.lit(op), found[fact], F.lit(float(threshold)))))
    return df.withColumns({"rule": F.coalesce(*named), "violated": F.coalesce(*judged)})


def clinical_facts(text: Column) -> dict[str, Column]:
    """Every quantity that the clinical gate may need. Creatinine is settled only if all its mentions agree; sex only if the opening is one-sided."""
    creatinine = spans.creatinine(text)
    head = F.substring(text, 1, 400)
    man, woman = (head.rlike(rf"(?i)\b{S.any_of(SEX_WORDS[x])}\b") for x in ("male", "female"))
    return {
        "creatinine_mgdl": creatinine["mgdl"],
        "creatinine_raw": creatinine["value"],
        "age": number(text, AGE),
        "sex": F.when(man & ~woman, "male").when(woman & ~man, "female"),
        "qt_ms": number(text, QT),
        "heart_rate": number(text, HEART_RATE),
        "weight_kg": number(text, WEIGHT),
        "height_cm": number(text, HEIGHT),
        "bilirubin": number(text, BILIRUBIN),
        "albumin": number(text, ALBUMIN),
        "inr": number(text, INR),
        "ascites_pts": graded(text, ASCITES),
        "enceph_pts": graded(text, ENCEPHALOPATHY),
    }


NEEDS = {
    "metformin": ["creatinine_mgdl", "age", "sex"],
    "ondansetron": ["qt_ms", "heart_rate"],
    "nitrofurantoin": ["creatinine_mgdl", "age", "sex", "weight_kg", "height_cm"],
    "apixaban": ["bilirubin", "albumin", "inr", "ascites_pts", "enceph_pts"],
}


def _stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later ones refer to by name: a generator keeps the optimiser from writing each out at every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def clinical_gate(df: DataFrame, text: str, equation: Column | None = None, only_needed: bool = False) -> DataFrame:
    """``df`` with the facts read, drug, quantity, fired, violated and declined.

    The first drug named picks the rule: filtration rate below 30 (metformin; ``equation``
    is ckd_epi unless it says mdrd), corrected QT above 500 (ondansetron), clearance below
    60 (nitrofurantoin), Child-Pugh of 10 or more (apixaban). ``declined`` names the facts
    that are missing, joined by plus signs, or says implausible, or that no drug is named.
    With ``only_needed`` the facts that a row's rule does not use are NULL, and not looked for.
    """
    low = F.lower(text)
    drug = reduce(lambda out, d: out.when(low.contains(d), d), list(NEEDS)[1:], F.when(low.contains("metformin"), "metformin"))
    x = _stage(df, {"drug": drug})
    read = clinical_facts(F.col(text))
    if only_needed:  # facts that the drug's rule does not ask for are not read
        asked = lambda n: F.col("drug").isin([d for d, names in NEEDS.items() if n in names])
        read = {n: F.when(asked("creatinine_mgdl" if n == "creatinine_raw" else n), c) for n, c in read.items()}
    x = _stage(x, read)
    c = {name: F.col(name) for name in read}
    equation = F.lit("ckd_epi") if equation is None else equation
    rate = F.when(equation == "mdrd", clinical.mdrd(c["creatinine_mgdl"], c["age"], c["sex"])).otherwise(clinical.ckd_epi(c["creatinine_mgdl"], c["age"], c["sex"]))
    weight = clinical.dosing_weight(c["weight_kg"], c["height_cm"], c["sex"])
    value = {
        "metformin": rate,
        "ondansetron": clinical.QTC["bazett"](c["qt_ms"], F.nullif(c["heart_rate"], F.lit(0.0))),
        "nitrofurantoin": clinical.cockcroft_gault(c["creatinine_mgdl"], c["age"], weight, c["sex"]),
        "apixaban": clinical.child_pugh(c["bilirubin"], c["albumin"], c["inr"], c["ascites_pts"], c["enceph_pts"]).cast("double"),
    }
    q = F.col("_q")
    odd = {
        "metformin": clinical.implausible(creatinine_mgdl=c["creatinine_mgdl"], eGFR=q),
        "ondansetron": clinical.implausible(qt_ms=c["qt_ms"], heart_rate=c["heart_rate"], QTc=q),
        "nitrofurantoin": clinical.implausible(creatinine_mgdl=c["creatinine_mgdl"]),
        "apixaban": F.lit(None).cast("string"),
    }
    pick = lambda by: reduce(lambda out, d: out.when(F.col("drug") == d, by[d]), list(by)[1:], F.when(F.col("drug") == "metformin", by["metformin"]))
    missing = {d: F.concat_ws("+", *[F.when(c[n].isNull(), n) for n in names]) for d, names in NEEDS.items()}
    x = _stage(x, {"_q": pick(value), "_missing": pick(missing)})
    declined = F.when(F.col("drug").isNull(), "no drug").when(F.col("_missing") != "", F.col("_missing")).when(q.isNull() | pick(odd).isNotNull(), "implausible")
    x = _stage(x, {"declined": declined})
    beyond = pick({"metformin": q < THRESHOLDS["metformin"], "ondansetron": q > THRESHOLDS["ondansetron"], "nitrofurantoin": q < THRESHOLDS["nitrofurantoin"], "apixaban": q >= THRESHOLDS["apixaban"]})
    fired = F.col("declined").isNull()
    return _stage(x, {"fired": fired, "quantity": F.when(fired, q), "violated": F.when(fired, beyond)}).drop("_q", "_missing")


def gate_report(gated: DataFrame, keys: Sequence[str], truth: dict[str, str], label: str = "label") -> DataFrame:
    """Of a gated table: rows, share that fired, right when fired, and of each fact in ``truth`` (fact: column) how many were read and right."""
    right = F.when(F.col("violated"), "UNSAFE").otherwise("SAFE") == F.col(label)
    same = lambda f, t: F.abs(F.col(f) - F.col(t)) < 1e-6 if dict(gated.dtypes)[f] != "string" else F.lower(f) == F.lower(t)
    counts = [F.count_if(F.col(f).isNotNull() & F.col(t).isNotNull()).alias(f"{f}_read") for f, t in truth.items()] + [F.count_if(same(f, t)).alias(f"{f}_right") for f, t in truth.items()]
    return gated.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("fired").cast("double")).alias("fire_rate"), F.avg(F.when(F.col("fired"), right.cast("double"))).alias("correct_when_fired"), *counts)


def states_derived(text: Column, quantity: str) -> Column:
    """Whether a name of the quantity has a digit among the 40 characters after it."""
    low = F.lower(text)
    return low.rlike(rf"(?s)\b{S.any_of(DERIVED[quantity])}\b.{{0,39}}\d")
