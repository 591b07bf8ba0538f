"""Text, gates, retrieval, graph, features and audits: the operators on the tables at hand."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from counterlens.functions import clinical, spans
from counterlens.operators import audits, causal_graph, concepts, effects, evidence, fanout, feature_scores, gates, guards, matching, metrics, ordered, retrieval, sampling
from counterlens.plans import samples
from counterlens.plans.registry import Tables, call
from counterlens.plans.scores import rounded
from counterlens.sources import files, questions
from counterlens.streaming import monitors


# ---- answers, facts, gates
@call
def f01_parse_answer(t: Tables):
    return t["preds"].select("id", "variant", gates.answer(F.col("raw")).alias("answer"))


@call
def a09_own_answer_accuracy(t: Tables):
    return rounded(t["preds"].groupBy("variant").agg(metrics.rate(gates.answer(F.col("raw")) == F.col("label")).alias("own_accuracy")), "own_accuracy")


@call
def f02_parse_label(t: Tables):
    return t["conversations"].select("conv_id", "turn", gates.option(F.col("text"), ["A", "B", "C", "D"]).alias("letter"), gates.option(F.col("text"), ["the", "of", "and"]).alias("word"))


@call
def f03_extract_facts(t: Tables):
    return samples.vignettes(t).select("event_id", *[x.alias(n) for n, x in gates.facts(F.col("vignette")).items()])


@call
def f04_rule_gate(t: Tables):
    return gates.rule_gate(samples.vignettes(t), "vignette", samples.RULES).select("event_id", "rule", "violated")


@call
def f05_mentions(t: Tables):
    found = samples.notes(t).select("event_id", "note").lateralJoin(spans.CreatinineMentions(F.col("note").outer()))
    return found.select("event_id", "value", "unit", (F.col("num_stop") - F.col("num_start")).cast("long").alias("digits"), F.round("mgdl", 9).alias("mgdl"))


FACTS = ["creatinine_mgdl", "age", "sex", "qt_ms", "heart_rate", "weight_kg", "height_cm", "bilirubin", "albumin", "inr", "ascites_pts", "enceph_pts"]


@call
def f06_extract_graded(t: Tables):
    read = gates.clinical_facts(F.col("note"))
    return rounded(samples.notes(t).select("event_id", *[(read[n] if n == "sex" else read[n].cast("double")).alias(n) for n in FACTS]), "creatinine_mgdl")


@call
def f07_clinical_gate(t: Tables):
    rows = samples.notes(t).drop("age", "sex", "bil", "alb")
    gated = gates.clinical_gate(rows, "note", F.when(F.col("event_id") % 12 == 0, "mdrd").otherwise("ckd_epi"), only_needed=True)
    return rounded(gated.select("event_id", "drug", "fired", "violated", "quantity", "declined"), "quantity", places=6)


@call
def a30_gate_diagnostics(t: Tables):
    """By drug: how often the gate fires and is right, what it read of what was true, and why it declined."""
    rows = samples.notes(t).withColumns({"true_age": F.col("age"), "true_sex": F.col("sex"), "true_qt": F.when(F.col("kind") == 2, F.col("qt")), "true_hr": F.when(F.col("kind") == 2, F.col("hr"))}).drop("age", "sex")
    gated = gates.clinical_gate(rows, "note")
    report = gates.gate_report(gated, ["drug"], {"age": "true_age", "sex": "true_sex", "qt_ms": "true_qt", "heart_rate": "true_hr"})
    why = gated.where("NOT fired").groupBy("drug", "declined").agg(F.count("*").alias("k"))
    reasons = why.groupBy("drug").agg(F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws("=", "declined", F.col("k").cast("string"))))).alias("declines"))
    return rounded(report.join(reasons, "drug", "left"), "fire_rate", "correct_when_fired")


@call
def f08_locate(t: Tables):
    notes = t["labs"].select("event_id", "value", F.concat(F.lit("Value "), F.col("value").cast("string"), F.lit(" seen; 12 beds.")).alias("note"))
    return notes.select("event_id", spans.locate_unique("note", "value").alias("s")).select("event_id", F.col("s.start").cast("double").alias("start"), F.col("s.stop").cast("double").alias("stop"))


@call
def f09_states_derived(t: Tables):
    notes = samples.notes(t).select("event_id", F.concat("note", F.when(F.col("event_id") % 7 == 0, F.lit(" eGFR was last seen at 44.")).when(F.col("event_id") % 7 == 1, F.lit(" The corrected QT is not known.")).otherwise("")).alias("note"))
    return notes.select("event_id", *[gates.states_derived(F.col("note"), q).alias(n) for q, n in (("eGFR", "egfr"), ("QTc", "qtc"), ("CrCl", "crcl"))])


@call
def m07_child_pugh(t: Tables):
    """Points from wordings, and the edit of bilirubin or albumin that crosses class C, or does not."""
    n = F.col("event_id")
    words = lambda d, x: F.element_at(F.array(*map(F.lit, [*clinical.FINDING_POINTS[d], "unheard of"])), (x % (len(clinical.FINDING_POINTS[d]) + 1) + 1).cast("int"))
    x = t["labs"].select("event_id", ((n % 50) / 10.0).alias("b"), (2 + (n % 30) / 10.0).alias("a"), (1 + (n % 20) / 10.0).alias("i"), words("ascites", n).alias("wa"), words("encephalopathy", F.floor(n / 7)).alias("we"))
    points = clinical.child_pugh(F.col("b"), F.col("a"), F.col("i"), clinical.finding_points("ascites", F.col("wa")), clinical.finding_points("encephalopathy", F.col("we")))
    x = x.withColumn("points", points)
    edit = lambda field, p, crossing: clinical.bracket_edit(field, p, F.col("points"), 10.0, crossing)
    bil, alb = clinical.bilirubin_points(F.col("b")), clinical.albumin_points(F.col("a"))
    made = {"points": F.col("points"), "bilirubin_flip": edit("bilirubin", bil, True)["value"], "bilirubin_control": edit("bilirubin", bil, False)["score"], "albumin_flip": edit("albumin", alb, True)["value"], "albumin_control": edit("albumin", alb, False)["score"]}
    return x.select("event_id", *[c.cast("double").alias(n) for n, c in made.items()])


@call
def m08_dispatch(t: Tables):
    """The formula that a row names."""
    n = F.col("event_id")
    x = t["labs"].join(t["patients"], "sid").withColumns({"scr": 0.3 + F.col("value") / 40, "kg": F.lit(45.0) + n % 60, "cm": F.lit(150.0) + n % 45, "kind": F.element_at(F.array(*map(F.lit, ["cockcroft_gault", "mdrd", "ckd_epi"])), (n % 3 + 1).cast("int"))})
    return x.select("event_id", "kind", F.round(clinical.compute(F.col("kind"), F.col("scr"), F.col("age"), F.col("sex"), F.col("kg"), F.col("cm")), 6).alias("v"))


@call
def m05_inverse(t: Tables):
    """Creatinine that brings each patient to 45 by the formula of the row; NULL where that is out of reach."""
    n = F.col("event_id")
    x = t["labs"].join(t["patients"], "sid").withColumns({"kg": F.lit(45.0) + n % 60, "cm": F.when(n % 7 > 0, F.lit(150.0) + n % 45), "kind": F.element_at(F.array(*map(F.lit, ["cockcroft_gault", "mdrd", "ckd_epi"])), (n % 3 + 1).cast("int"))})
    target = F.when(n % 11 == 0, 2500.0).otherwise(45.0)
    return x.select("event_id", F.round(clinical.solve_creatinine(F.col("kind"), target, F.col("age"), F.col("sex"), F.col("kg"), F.col("cm")), 6).alias("creatinine"))


@call
def p01_implausible(t: Tables):
    """The first of the seven windows that a lab's derived values leave."""
    n = F.col("event_id")
    x = t["labs"].join(t["patients"], "sid").withColumns({"scr": F.col("value") / 20, "qt": F.lit(150.0) + n % 600, "hr": F.lit(15.0) + n % 230, "k": (10 + n % 90) / 10.0, "r": (2 + n % 140) / 10.0})
    x = x.withColumns({"egfr": clinical.ckd_epi(F.col("scr"), F.col("age"), F.col("sex")), "qtc": clinical.QTC["bazett"](F.col("qt"), F.col("hr"))})
    windows = {"creatinine_mgdl": "scr", "eGFR": "egfr", "qt_ms": "qt", "heart_rate": "hr", "QTc": "qtc", "potassium_mEqL": "k", "inr": "r"}
    return x.select("event_id", clinical.implausible(**{w: F.col(c) for w, c in windows.items()}).alias("bad"))


@call
def p06_drop_reasons(t: Tables):
    """Notes that may become items, and why the others do not; counted in the pass that keeps them."""
    notes = samples.notes(t).withColumn("copy", F.row_number().over(Window.partitionBy("note").orderBy("event_id")))
    values = F.array_distinct(F.transform(spans.creatinines(F.col("note")), lambda m: F.round(m["mgdl"], 6)))
    notes = notes.withColumns({"values": values, "words": F.size(F.split(F.trim("note"), r"\s+"))}).withColumn("scr", F.get("values", F.lit(0)))
    notes = notes.withColumn("egfr", clinical.ckd_epi(F.col("scr"), F.col("age"), F.col("sex")))
    chain = [
        ("copy of a note", F.col("copy") > 1),
        ("creatinine not stated with a unit", F.size("values") == 0),
        ("creatinine stated with different values", F.size("values") > 1),
        ("states the derived value", gates.states_derived(F.col("note"), "eGFR")),
        ("too long", F.col("words") > 12),
        ("implausible", clinical.implausible(creatinine_mgdl=F.col("scr"), eGFR=F.col("egfr")).isNotNull()),
        ("too close to the threshold", F.abs(F.col("egfr") - 30) < 3),
    ]
    kept, seen = guards.guarded(notes, chain)
    path = files.scratch_path(t.spark, "kept")
    kept.select("event_id", "note").write.parquet(path)
    if t.spark.read.parquet(path).count() != seen.get[guards.KEPT]:
        raise AssertionError("counters and rows of one pass differ")
    return t.spark.createDataFrame(list(seen.get.items()), "reason string, n long")


@call
def a43_drop_counters(t: Tables):
    chain = [("low", F.col("q") < 2), ("high", F.col("q") > 200), ("old", F.col("age") > 80), ("near the threshold", F.abs(F.col("q") - F.col("threshold")) < 0.05 * F.col("threshold"))]
    return guards.drop_counters(t["facts"], chain, ["family"])


def _digits(prompts: list[str]) -> list[tuple]:
    """What stands in for a model: digits of a prompt, and a checksum."""
    return [(sum(c.isdigit() for c in p), int(hashlib.md5(p.encode()).hexdigest()[:7], 16)) for p in prompts]


@call
def x01_dedup_fanout(t: Tables):
    out, _ = fanout.evaluate_once(t["items"], "prompt", _digits, "digits long, checksum long", F.char_length("prompt"))
    return out.select("id", F.col("length").cast("long").alias("length"), "batch", "digits", "checksum")


@call
def p14_justification(t: Tables):
    return t["preds"].select("id", "variant", evidence.justification(F.col("raw")).alias("why")).where("why IS NOT NULL")


@call
def p10_redact(t: Tables):
    """Prompts of three forms; a family's patterns are tried in their order, and one form matches none."""
    n, value = F.col("item_no"), F.round("factor_value").cast("long").cast("string")
    prompt = F.when(n % 3 == 0, F.col("prompt")).when(n % 3 == 1, F.concat(F.lit("Level "), value, F.lit(" units; level "), value, F.lit(" units before."))).otherwise("No number here.")
    return t["items"].select("id", spans.redact_first(prompt, [r"(has value )\d+", r"([Ll]evel )\d+ units"]).alias("redacted"))


@call
def p09_option_swap(t: Tables):
    return t["items"].select("id", spans.swap_once(F.col("prompt"), "Is it safe", "Is it unsafe or safe").alias("swapped"))


@call
def s11_adapters(t: Tables):
    """Three question sets of different forms, made of parts, suppliers and conversations."""
    k = F.col("p_partkey")
    parts = t["part"].withColumn("right", k % 4)
    one = questions.by_columns(parts, "parts", "p_partkey", "p_name", ["p_brand", "p_type", "p_name", "p_brand"], "right", "Which?\n{question}\n{options}\nAnswer:", {"size": F.col("p_size")})
    options = F.map_filter(F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two"), F.lit("C"), F.lit("three"), F.lit("D"), F.lit("four")), lambda x, _: (x != "C") | (k % 2 == 0))
    two = questions.by_map(t["part"].select("p_partkey", "p_name", options.alias("o"), F.when(k % 3 == 0, "A").otherwise("D").alias("answer")), "maps", "p_partkey", "p_name", "o", "answer", "{question}\n{options}", most_words=3)
    turns = t["conversations"].groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("c"))
    three = questions.by_context(turns.select("conv_id", "c", F.lit(" Is it so? ").alias("q"), F.element_at(F.array(*map(F.lit, ["Yes", " no", "Maybe "])), (F.col("conv_id") % 3 + 1).cast("int")).alias("d")), "talks", "conv_id", "q", "c", "d", "{context}\nQ: {question}", most_words=12)
    out = one.unionByName(two).unionByName(three)
    return out.select("source", "id", F.sha2("prompt", 256).alias("prompt"), F.concat_ws("|", "labels").alias("labels"), "gold", F.to_json("meta").alias("meta"))


@call
def s22_corpus(t: Tables):
    guidelines = t["rules"].select(F.col("family").alias("id"), F.concat(F.lit("Threshold for "), "family").alias("text"))
    return questions.passages(guidelines, t["benchmark"].select(F.col("item_id").alias("id"), "text"), t["documents"].where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.concat(F.lit("  "), "text", F.lit("\n\n")).alias("text")))


@call
def t06_edge_dedup(t: Tables):
    """The edges that parts claim, each once."""
    return t["part"].select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("COMES_AS").alias("rel"), F.concat(F.lit("size "), (F.col("p_size") % 5).cast("string")).alias("provenance")).distinct()


@call
def p03_dynamic_predicate(t: Tables):
    """Every lab under the comparison that a rule on its item names; a rule without labs has one row."""
    return t["rules"].join(t["labs"], "item", "left").select("event_id", "family", gates.compare(F.col("op"), F.col("value"), F.col("threshold")).alias("holds"))


@call
def p11_adapt(t: Tables):
    return t["items"].select(F.concat("id", F.lit("__note")).alias("id"), F.concat("pair_id", F.lit("__note")).alias("pair_id"), F.lit("note").alias("presentation"), "label")


@call
def m01_ckd_epi(t: Tables):
    x = t["labs"].join(t["patients"], "sid")
    return x.select("event_id", F.round(clinical.ckd_epi(F.lit(0.3) + F.col("value") / F.lit(40.0), F.col("age"), F.col("sex")), 6).alias("egfr"))


def _restated(t: Tables):
    """Items whose prompt has lines with other numbers before the one that states the value with its decimals."""
    value = F.col("factor_value").cast("decimal(18,2)").cast("string")
    told = F.concat(F.lit("Seen before: value 7.\nIn bed 12.\n"), F.col("family"), F.lit(": value "), value, F.lit(". Is it safe?"))
    shown = F.col("shown")
    quantity = F.when(F.col("convert") == "ckd_epi", clinical.ckd_epi(F.lit(0.3) + shown / F.lit(40.0), F.col("age"), F.col("sex"))).otherwise(shown)
    rows = t["items"].join(F.broadcast(t["rules"].select("family", "convert")), "family").join(t["patients"], "sid").withColumn("told", told)
    return audits.from_prompt(rows, "told", r"value (\d+(?:\.\d+)?)", quantity)


@call
def f19_label_from_prompt(t: Tables):
    return _restated(t).select("id", "shown", F.col("decimals").cast("long").alias("decimals"), F.col("relabelled").alias("label"))


@call
def f20_rederivation(t: Tables):
    """Items from their prompts, and predictions from their parts."""
    items = audits.rederived(_restated(t), ["family"]).select(F.lit("item").alias("part"), F.col("family").alias("name"), "n", *[F.col(c).alias(x) for c, x in (("unread", "a"), ("value_off", "b"), ("label_off", "c"))])
    preds = t["preds"].withColumns({"violated": F.col("label") == "UNSAFE", "tau": F.lit(0.5)})
    made = audits.decisions_rederived(preds, ["variant"], gates.answer(F.col("raw")), clinical.decision_entropy(F.col("logit_margin")))
    decisions = made.select(F.lit("decision").alias("part"), F.col("variant").alias("name"), "n", F.col("entropy_off").alias("a"), (F.col("gate_off") + F.col("pred_off")).alias("b"), F.col("abstained_off").alias("c"))
    return items.unionByName(decisions)


@call
def f22_truncate_words(t: Tables):
    return t["conversations"].select("conv_id", "turn", spans.truncate_words(F.col("text"), 12).alias("cut"))


@call
def f11_rewrite(t: Tables):
    notes = t["labs"].select("event_id", F.concat(F.lit("A "), F.col("value").cast("string"), F.lit(" B")).alias("note"), F.length(F.col("value").cast("string")).alias("n"))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))
    where = F.array(span(F.lit(0), F.lit(1)), span(F.lit(2), 2 + F.col("n")))
    return notes.select("event_id", spans.rewrite_spans(F.col("note"), where, F.array(F.lit("Z"), F.lit("7"))).alias("note"))


# ---- sections, sentences, evidence, concepts
@call
def f12_section_excerpt(t: Tables):
    text = F.concat(F.lit("Admitted.\nBrief Hospital Course:\n"), "text", F.lit("\nDischarge Medications:\nnone"))
    body, reason = evidence.section(text, r"(?i:brief hospital course\s*:?)", 400)
    return t["documents"].where("text IS NOT NULL").select("doc_id", body.alias("excerpt"), reason.alias("reason"))


@call
def f13_sentences(t: Tables):
    return evidence.sentences(t["documents"].select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@call
def f14_number_sentences(t: Tables):
    rows = evidence.sentences(t["documents"].select("doc_id", "lang", "text"), "text", most=5)
    return rows.select("doc_id", "lang", F.col("place").cast("long").alias("place"), F.sha2("sentence", 256).alias("sentence"), "has_number")


def _found(t: Tables):
    specs = t.spark.createDataFrame(samples.SPECS, samples.SPEC_SCHEMA)
    return evidence.attestation(evidence.evidence(samples.label_texts(t), specs))


@call
def f15_evidence(t: Tables):
    return _found(t).select("family", "section", "value", F.length("context").cast("double").alias("context_chars"))


@call
def f16_attestation(t: Tables):
    return _found(t).select("family", "status")


@call
def j21_containment(t: Tables):
    """A worksheet of the labels' sentences, filled from the evidence."""
    rows = evidence.sentences(samples.label_texts(t), "text").withColumn("row", F.concat_ws("/", "drug", "section", F.col("seq").cast("string"), F.col("place").cast("string")))
    filled = evidence.fill_worksheet(rows.select("row", "drug", "section", "sentence"), _found(t))
    return filled.where("family IS NOT NULL").select("row", "family", "status")


@call
def a54_provenance_rollup(t: Tables):
    out = evidence.provenance_rollup(_found(t).select("family", "status"), F.col("status").isin("attested_exact", "attested_different_value"))
    return out.select("family", "status", F.col("place").cast("long").alias("place"), "n_attested", "n_families")


def _concepts() -> dict[str, tuple[list[str], list[str]]]:
    """Full wordings of each concept, and those without its variants."""
    words = lambda name, s, v: concepts.wordings(s, v, stop=["of"], name=name)
    return {name: (words(name, s, v), words(name, s, ())) for name, (s, v) in samples.CONCEPTS.items()}


@call
def f17_concept_matcher(t: Tables):
    """Matches of one concept in every text, and how many characters they cover."""
    return concepts.covered(t["documents"], "text", {"definite": _concepts()["definite"][0]}, ["doc_id"]).drop("concept")


@call
def a50_concept_hits(t: Tables):
    return concepts.concept_hits(t["documents"], "text", _concepts(), ["lang"])


@call
def p16_provenance(t: Tables):
    atoms = t.spark.createDataFrame([(c, len([x for x in s if len(x) >= 3])) for c, (s, _) in samples.CONCEPTS.items()], "concept string, atoms int")
    hits = concepts.concept_hits(t["documents"], "text", _concepts(), [])
    return hits.join(F.broadcast(atoms), "concept").select("concept", evidence.grounding(F.col("atoms"), F.col("full"), F.col("bare")).alias("state"))


@call
def f18_norm_atom(t: Tables):
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" (Disorder)")).otherwise(F.lit(" [disease/finding]")))
    return t["conversations"].where("text IS NOT NULL").select("conv_id", "turn", F.sha2(evidence.norm_atom(text), 256).alias("atom"))


@call
def f21_word_presence(t: Tables):
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(r"(?i)\b(UNSAFE|SAFE)\b"), F.lit(1)), F.upper)))
    return t["preds"].select("id", "variant", F.concat_ws("+", words).alias("words"))


@call
def f25_age_phrase(t: Tables):
    """Ages of children, 4 to 17, derived from those of patients, as a school stage."""
    ages = t["patients"].select("sid", (F.col("age") % 14 + 4).alias("age"))
    return ages.select("sid", "age", clinical.school_year(F.col("age")).alias("phrase"))


# ---- retrieval
def _corpus(t: Tables):
    guidelines = t["rules"].select(F.concat(F.lit("guideline::"), "family").alias("id"), F.concat(F.lit("Threshold for "), "family", F.lit(" patients")).alias("text"))
    return guidelines.unionByName(t["benchmark"].select(F.concat(F.lit("distractor::"), F.col("item_id").cast("string")).alias("id"), "text"))


@call
def f27_tfidf(t: Tables):
    by = retrieval.tfidf(t["benchmark"], "item_id", "text").groupBy(F.col("key").alias("item_id"))
    return by.agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top"), F.round(F.sum("w"), 6).alias("total"))


@call
def j15_tfidf_top_k(t: Tables):
    return rounded(retrieval.top_passages(t["documents"], t["benchmark"], "doc_id", "item_id").withColumn("rank", F.col("rank").cast("long")), "score", places=6)


@call
def a29_retrieval_hits(t: Tables):
    """Guidelines retrieved for the distinct prompts, judged for every item of the variant that retrieves."""
    items = t["preds"].where("variant = 'rag'")
    prompts = items.groupBy("prompt").agg(F.min("item_no").alias("no"))
    ranked = retrieval.top_passages(prompts.withColumnRenamed("prompt", "text"), _corpus(t), "no", "id")
    truth = items.join(prompts, "prompt").select("no", "family", F.concat(F.lit("guideline::"), "family").alias("gold"), F.coalesce(F.col("pred") == F.col("label"), F.lit(False)).alias("ok"))
    both = retrieval.hits(ranked, "no", "id", truth, "gold", ["family"], "distractor::").unionByName(retrieval.hits(ranked, "no", "id", truth.withColumn("family", F.lit("POOLED")), "gold", ["family"], "distractor::"))
    return rounded(both, *[c for c in both.columns if c not in ("family", "n")])


@call
def o01_top_k_retrieval(t: Tables):
    found = retrieval.nearest(t["embeddings"].where("vec_id % 20 = 0"), t["embeddings"], "vec_id", "embedding", 3)
    return found.select("query_id", F.col("id").alias("vec_id"), "sim")


@call
def j16_dictionary_match(t: Tables):
    """The nearest direction, by the size of its cosine, of each vector of the even labels among those of the odd ones."""
    e = t["embeddings"]
    return retrieval.nearest(e.where("label % 2 = 0"), e.where("label % 2 = 1"), "vec_id", "embedding", 1, absolute=True, unit=True).select(F.col("query_id").alias("x"), F.col("id").alias("y"), F.col("sim").alias("c"))


# ---- graph
def _graph(t: Tables, by_size: bool = False):
    return causal_graph.build(*samples.graph_claims(t, by_size))


@call
def g01_graph_build(t: Tables):
    nodes, _ = _graph(t)
    return nodes.select("cui", "kind", F.concat_ws("|", "atom_keys").alias("atom_keys"))


@call
def g02_contraindications(t: Tables):
    return causal_graph.contraindications(_graph(t)[1])


@call
def g03_mechanisms(t: Tables):
    return causal_graph.mechanisms(_graph(t)[1]).select("src", F.concat_ws("|", "annotations").alias("annotations"))


@call
def g04_attestation(t: Tables):
    return causal_graph.attestation(*_graph(t, by_size=True))


@call
def a39_graph_coverage(t: Tables):
    return rounded(causal_graph.coverage(causal_graph.attestation(*_graph(t, by_size=True))), "fraction")


@call
def m15_ontology_margin(t: Tables):
    """Margins of all pairs of a drug and a finding, with or without a claim."""
    nodes, edges = _graph(t, by_size=True)
    findings = nodes.where("cui LIKE 'F:%'").select(F.col("cui").alias("dst"))
    pairs = nodes.where("kind = 'drug'").select(F.col("cui").alias("src")).crossJoin(findings)
    return causal_graph.margins(pairs, edges, causal_graph.attestation(nodes, edges), 2.0)


@call
def g05_layered_build(t: Tables):
    return _graph(t)[1]


@call
def g06_round_trip(t: Tables):
    nodes, edges = causal_graph.round_trip(t.spark, *_graph(t), files.scratch_path(t.spark, "graph"))
    return edges.unionByName(nodes.select(F.col("cui").alias("src"), F.lit("").alias("dst"), F.col("kind").alias("rel"), F.concat_ws("|", "atom_keys").alias("provenance"), F.col("name").alias("source")))


@call
def j19_edge_preference(t: Tables):
    return causal_graph.preferred(_graph(t)[1])


@call
def j20_set_overlap(t: Tables):
    """Concepts of the two stages that share a surface form."""
    return causal_graph.overlaps(_graph(t, by_size=True)[0])


# ---- features and effects
def _scored(t: Tables):
    active = samples.activations(t)
    concepts = t["events"].select("event_id", F.col("event_type").alias("concept"))
    return feature_scores.f1(feature_scores.counts(active.select("event_id", "feature"), concepts, "event_id"))


@call
def a31_feature_counts(t: Tables):
    return _scored(t).drop("f1")


@call
def a32_best_concept(t: Tables):
    return rounded(feature_scores.best_concept(_scored(t)), "f1")


@call
def a33_influence_score(t: Tables):
    by = _scored(t).groupBy("feature").agg(feature_scores.influence(F.max("f1"), 4 * (F.max("f1") - F.avg("f1"))).alias("score"))
    return rounded(by, "score")


@call
def a34_control_spread(t: Tables):
    return rounded(feature_scores.spread(_scored(t), ["concept"], "f1", F.lit(0.1)), "mean", "sd", "worst")


@call
def a35_layer_effect(t: Tables):
    return rounded(effects.layer_effects(samples.effects(t).where("alpha = 1"), ["layer"]), "ace", "control", "excess", "normalised")


def _cells(t: Tables):
    return effects.sweep_cells(samples.sweep(t), ["run", "layer"], "alpha")


@call
def a36_dose_response(t: Tables):
    table = effects.dose_table(samples.effects(t), ["layer"], "alpha")
    by = table.groupBy("layer").agg(F.avg("shuffled_control").alias("shuffled_control"), F.min("n").alias("n"))
    return rounded(effects.dose_response(table, ["layer"], "alpha").join(by, "layer"), "best_excess", "shuffled_control")


@call
def a37_best_cell(t: Tables):
    return rounded(effects.best_cell(_cells(t), ["run"], "layer", "alpha"), "cc", "cc_rand", "gain", "base", "control_swing")


@call
def a38_concept_jaccard(t: Tables):
    """Sources by the lengths, in thousands of characters, that they have in each language."""
    members = t["documents"].select("source", F.concat_ws("/", "lang", (F.col("n_chars") - F.col("n_chars") % 1000).cast("string")).alias("member"))
    return rounded(feature_scores.set_agreement(members, "source", "member"), "jaccard")


@call
def a40_aopc(t: Tables):
    """Comprehensiveness and sufficiency over a grid of four rationale sizes."""
    p = lambda k: F.array(*[0.9 / (1 + F.abs(F.col("h")) * (i + k) / 10.0) for i in range(1, 5)])
    rows = samples.effects(t).groupBy("pair_id", "layer").agg(F.avg(F.abs("delta")).alias("h")).withColumns({"clean": F.lit(0.9), "without": p(2), "only": p(0)})
    return rounded(feature_scores.faithfulness(rows, ["layer"], "clean", "without", "only"), "aopc_comprehensiveness", "aopc_sufficiency")


@call
def a41_edit_percentile(t: Tables):
    """Words of the prompts as tokens, of which those before the question are candidates; their scores are hashes."""
    words = t["items"].select("pair_id", "arm", "item_no", F.posexplode(F.split("prompt", " ")).alias("position", "token"))
    tokens = words.select("pair_id", "arm", "position", "token", (F.col("position") < 6).alias("candidate"), ((F.col("item_no") * 31 + F.col("position") * 97531) % 1009).alias("score"))
    return rounded(effects.edited_percentile(tokens).withColumnRenamed("edited", "n"), "percentile")


@call
def a44_index_quantile(t: Tables):
    return ordered.index_quantile(t["facts"], ["family"], "q", ["event_id"], 0.9).withColumnRenamed("q", "p90")


@call
def a42_pointing(t: Tables):
    out = effects.pointing(*samples.token_scores(t))
    return rounded(out, *[c for c in out.columns if not c.startswith("n")])


@call
def a48_contraction(t: Tables):
    at = lambda a: F.when(F.col("alpha") == a, F.col("delta")).otherwise(0.0)
    return rounded(samples.effects(t).agg(feature_scores.contraction(at(1.0), at(0.5)).alias("contraction")), "contraction")


@call
def a52_perplexity(t: Tables):
    """Windows of a text of which the last ends it; the loss of a window is its mean."""
    w = t["documents"].select("lang", (F.lit(1.0) + (F.col("doc_id") % 100) / 100.0).alias("nll"), F.col("n_chars").alias("len"))
    ends = w.groupBy("lang").agg((F.sum("len") + 1).alias("end"))
    return rounded(feature_scores.perplexity(w.join(ends, "lang"), ["lang"], "nll", "len", "end"), "ppl", places=6)


@call
def a53_signed_best(t: Tables):
    return rounded(effects.signed_arms(_cells(t), ["run"], "layer", "alpha"), "cc", "cc_rand", "gain")


@call
def j17_matched_controls(t: Tables):
    by = t["events"].groupBy(F.concat_ws("_", "event_type", (F.col("user_id") % 20).cast("string")).alias("feature")).agg(F.count("*").alias("n"))
    out = matching.matched_controls(by).withColumn("place", F.col("place").cast("long"))
    return rounded(out, "log_ratio")


@call
def j18_span_overlap(t: Tables):
    c = F.col("conv_id")
    tokens = t["conversations"].select("conv_id", "turn", (F.col("turn") * 10).alias("s"), (F.col("turn") * 10 + 8).alias("e"))
    return matching.overlapping(tokens, t["conversations"].select("conv_id").distinct().withColumns({"a": 5 + c % 20, "b": 15 + c % 20}), "conv_id").select("conv_id", "turn")


def _notes_in_time(t: Tables, usable: str):
    pairs = t["items"].where("NOT is_control").groupBy("pair_id", "sid").agg(F.min("ts").alias("t0"))
    notes = t["labs"].where("item = 'signup'").where(usable).select(F.col("event_id").alias("note_id"), "sid", "ts")
    return matching.nearest_in_time(pairs, notes, "sid", "pair_id", "t0", "note_id", "ts", 6)


@call
def j13_nearest_note(t: Tables):
    return _notes_in_time(t, "TRUE")


@call
def j14_nearest_usable(t: Tables):
    """The nearest note that can be used; those that cannot are passed over."""
    return _notes_in_time(t, "value > 50")


@call
def m10_scalars(t: Tables):
    m = F.col("logit_margin")
    return t["preds"].where(m.isNotNull()).select("item_no", "variant", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), m / 4)), 6).alias("clipped"), F.round(1 / (1 + F.exp(-m)), 6).alias("sigmoid"), F.round(F.ln(F.abs(m) + 1), 6).alias("log"))


@call
def m12_rescale(t: Tables):
    return rounded(feature_scores.rescale(t["embeddings"], ["label"], "embedding"), "scale", places=6)


@call
def m13_sparsify(t: Tables):
    """Top-8 code and gated code of every vector: live entries and their sum."""
    v = F.col("embedding").cast("array<double>")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    live = lambda c: F.size(F.filter(c, lambda x: x > 0)).cast("long")
    top, gated = feature_scores.top_k_code(v, 8), feature_scores.gated_code(v, -2.0)
    return t["embeddings"].select("vec_id", live(top).alias("top_live"), total(top).alias("top_sum"), live(gated).alias("gated_live"), total(gated).alias("gated_sum"))


@call
def m14_kind_map(t: Tables):
    """Arrays of semantic types as kinds, and relations as edges; unknown ones have none."""
    n = F.col("event_id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    types = F.array(pick(["T999", "T047", "T121"], n), pick(["T059", "T033", "T998", "T044", "T195"], n))
    return t["events"].select(causal_graph.kind_of(types).alias("kind"), causal_graph.edge_of(pick([*causal_graph.EDGES, "isa"], n)).alias("edge")).groupBy("kind", "edge").agg(F.count("*").alias("n"))


# ---- audits
@call
def a22_distinct_prompts(t: Tables):
    by = t["items"].groupBy("split", "family").agg(F.count("*").alias("n"), F.count_distinct("prompt").alias("n_prompts"))
    return by.withColumn("ratio", F.round(F.col("n") / F.col("n_prompts"), 9))


@call
def a23_conflicts(t: Tables):
    return rounded(audits.conflicts(t["items"], "prompt", "label", "family"), "share")


@call
def a24_same_prompt_other_answer(t: Tables):
    return audits.varying_answers(t["preds"], ["variant"], "prompt", "pred")


@call
def a26_pair_census(t: Tables):
    return audits.pair_census(t["items"], ["split"])


@call
def a27_label_recompute(t: Tables):
    unsafe = F.when(F.col("op") == "<", F.col("q") < F.col("threshold")).otherwise(F.col("q") > F.col("threshold"))
    return audits.recomputed(t["items"], ["family", "is_control"], "label", F.when(unsafe, "UNSAFE").otherwise("SAFE"))


@call
def j05_aligned_variants(t: Tables):
    p = t["preds"]
    return audits.aligned(p.where("variant = 'base'").select("id", F.col("correct").alias("base_ok")), p.where("variant = 'nsai_uq_cl'"), "id", {"correct": "all_ok"})


@call
def j08_anti_joins(t: Tables):
    preds = t["preds"].where("variant = 'base' AND h2 % 13 <> 0").select("id").unionByName(t["items"].where("item_no % 30 = 0").select(F.concat("id", F.lit("x")).alias("id")))
    return audits.id_match(t["items"], preds.unionByName(preds.where("id LIKE '%0_safe'")), "id")


@call
def j09_split_leakage(t: Tables):
    return audits.shared_between_splits(t["documents"].withColumn("split", F.col("doc_id") % 4), "text", "split")


@call
def j12_unseen_pairs(t: Tables):
    items = t["items"]
    return audits.unseen(items.where("split = 'test'"), items.where("split = 'train'"), "prompt", "pair_id")


def _accuracy(t: Tables, where: str):
    return t["preds"].where(where).groupBy("family").agg(F.round(metrics.rate("correct"), 6).alias("m"))


@call
def j22_artifact_diff(t: Tables):
    """Two runs by family; each lacks one, and one family has no number in either."""
    old = _accuracy(t, "variant = 'base' AND family <> 'held'").withColumn("m", F.when(F.col("family") != "high", F.col("m")))
    new = _accuracy(t, "variant = 'rag'").withColumn("m", F.when(F.col("family") != "high", F.col("m")))
    return rounded(audits.difference(old, new, ["family"], "m"), "delta", places=6)


@call
def j24_moved_rows(t: Tables):
    run = lambda v: t["preds"].where(f"variant = '{v}'").groupBy((F.col("item_no") % 5).alias("layer"), "family").agg(F.round(metrics.rate("correct"), 6).alias("m"), F.count_if(F.col("pred").isNotNull()).alias("used"))
    return rounded(audits.moved(run("base"), run("rag"), ["layer", "family"], "m", "layer"), "change", places=6)


@call
def t04_equal_sets(t: Tables):
    return audits.same_sets(t["items"], t["preds"], "id")


# ---- sampling
@call
def o02_top_features(t: Tables):
    return t["documents"].groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@call
def o04_patient_split(t: Tables):
    return sampling.split(t["patients"].select("sid"), "sid", sampling.hashed(F.col("sid"), 2654435761), {"test": 0.5, "calib": 0.2}, "train")


@call
def o05_pair_split(t: Tables):
    pairs = t["items"].where("NOT is_control").groupBy("pair_id", "held_out").agg(F.min("item_no").alias("no"))
    draw = F.when(F.col("held_out"), sampling.hashed(F.col("no"), 40503)).otherwise(sampling.hashed(F.col("no"), 97531))
    return sampling.split(pairs, "pair_id", draw, {"test": 0.5, "calib": 0.2}, "train", by=["held_out"]).select("pair_id", "split")


@call
def o06_pair_sample(t: Tables):
    pairs = t["items"].where("NOT is_control").groupBy("split", "pair_id").agg(F.min("item_no").alias("no"))
    return sampling.sample(pairs, ["split"], sampling.hashed(F.col("no"), 2654435761), "pair_id", 10).select("split", "pair_id")


@call
def o07_stratified(t: Tables):
    stratum = F.when(F.col("abstained"), "deferral").when((F.col("label") == "UNSAFE") & (F.col("pred") == "SAFE"), "violation").otherwise("other")
    rows = t["preds"].withColumn("stratum", stratum)
    return sampling.sample(rows, ["variant", "stratum"], F.col("h1"), "id", F.when(F.col("stratum") == "other", 4).otherwise(3)).select("variant", "stratum", "id")


@call
def o08_repeats_and_order(t: Tables):
    """A tenth of the items planted again, and an order of all of them for each rater."""
    items = t["items"].select("id", "item_no")
    planted = sampling.plant_repeats(items, "id", sampling.hashed(F.col("item_no"), 97531), 0.1)
    return sampling.rater_orders(planted, "id", ["rater1", "rater2"]).select("rater", "id", "repeat_of", "order_hash")


@call
def o12_budget(t: Tables):
    return sampling.within(t["documents"], ["lang"], "doc_id", "n_chars", 50000).select("doc_id", "running")


@call
def st3_budget(t: Tables):
    """A stream of documents, in batches of ids, of which each language's are taken while its budget lasts."""
    return monitors.budgeted(t.spark, t["documents"].select(F.col("lang").alias("stream"), F.col("doc_id").alias("seq"), F.col("n_chars").cast("long").alias("size")), 20_000).select("stream", F.col("seq").alias("doc_id"), "running")


@call
def w11_previous_group(t: Tables):
    """The effect of the pair before, in the order of patients, as a shuffled control."""
    by = t["items"].where("NOT is_control").groupBy("family", "sid").agg(F.round(F.max("q") - F.min("q"), 6).alias("delta"))
    return ordered.with_previous(by, ["family"], ["sid"], "delta", "prev_delta")
