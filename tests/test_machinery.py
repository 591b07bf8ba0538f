"""Guards, fan-out, the concept automaton, the probe's null and retrieval in blocks, against plain versions."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterlens.functions import clinical
from counterlens.operators import concepts, fanout, guards, probe, retrieval
from counterlens.plans import catalogue


# ---- guards
def test_guards_are_judged_in_order_and_counted_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50), (4, 7), (5, -1)], "i int, v int")
    chain = [("missing", F.col("v").isNull()), ("large", F.col("v") > 10), ("odd", F.col("v") % 2 != 0)]
    kept, seen = guards.guarded(df.withColumn("extra", F.lit("x")), chain)
    kept.write.parquet(str(tmp_path / "kept"))
    assert kept.columns == ["i", "v", "extra"] and spark.read.parquet(str(tmp_path / "kept")).count() == 0
    assert seen.get == {"missing": 1, "large": 1, "odd": 3, "kept": 0}
    # the order decides: 50 is even, so of the two last guards the first to fail names it
    assert {r.reason: r.n for r in guards.drop_counters(df, chain[::-1]).collect()} == {"missing": 1, "large": 1, "odd": 3}
    assert {(r.g, r.reason): r.n for r in guards.drop_counters(df.withColumn("g", F.col("i") > 2), chain[:2], ["g"]).collect()} == {(False, "kept"): 1, (False, "missing"): 1, (True, "large"): 1, (True, "kept"): 2}
    with pytest.raises(ValueError):
        guards.guarded(df, chain + chain[:1])


# ---- fan-out
def test_prompts_are_evaluated_once_in_fixed_batches(spark):
    rnd = random.Random(1)
    prompts = [f"p{'x' * rnd.choice([1, 1, 1, 2, 5])}{i}" for i in range(90)]
    items = [(i, rnd.choice(prompts + [None])) for i in range(400)]
    df = spark.createDataFrame(items, "id int, prompt string").repartition(5)

    def evaluate(batch):
        assert len(batch) == 4 and len({len(p) for p in batch}) == 1
        return [(p[::-1], "|".join(batch)) for p in batch]

    out, seen = fanout.evaluate_once(df, "prompt", evaluate, "answer string, around string", F.char_length("prompt"), size=4)
    got = {r.id: r for r in out.collect()}
    used = sorted({p for _, p in items if p})
    by = {}
    for p in used:
        by.setdefault(len(p), []).append(p)
    want = {}
    for group in by.values():
        for k in range(0, len(group), 4):
            batch = group[k : k + 4]
            for p in batch:
                want[p] = (p[::-1], "|".join(batch + batch[-1:] * (4 - len(batch))), k // 4)
    assert len(got) == 400 and all((got[i].answer, got[i].around, got[i].batch) == want[p] if p else got[i].answer is None for i, p in items)
    assert seen.get == {"distinct": len(used), "batches": sum(-(-len(g) // 4) for g in by.values())}


# ---- concepts
def _pattern(words, tail=""):
    return re.compile(r"(?i)\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")\b" + tail)


def test_automaton_agrees_with_regular_expressions():
    rnd = random.Random(2)
    words = ["ab", "abc", "ab c", "c", "c ab", "é", "aé", "a-b", "-a", "b.", "AB cd", "cd"]
    for _ in range(300):
        chosen = {f"k{i}": rnd.sample(words, rnd.randrange(1, 6)) for i in range(3)}
        m = concepts.Matcher(chosen)
        text = "".join(rnd.choice(["ab", "AB", "c", " ", " ", "é", "-", ".", "a", "cd", "_", "1"]) for _ in range(25))
        got = {m.names[i]: spans for i, spans in m.spans(text).items()}
        assert got == {c: s for c, w in chosen.items() if (s := [x.span() for x in _pattern(w).finditer(text)])}, (chosen, text)
    m = concepts.Matcher({"dose": ["dose", "dose of"]}, {"dose": r"\s*\d+"})
    text = "dose of 5, dose 7, dose of x, DOSE9"
    assert [text[a:b] for a, b in m.spans(text)[0]] == ["dose of 5", "dose 7"]
    assert m.spans(None) == {} == m.spans("") and concepts.Matcher({"none": []}).spans("a") == {}


def test_a_hundred_thousand_wordings_in_bounded_parts(spark, monkeypatch):
    rnd = random.Random(3)
    many = {f"c{i}": [f"{rnd.randrange(10**9):x} {rnd.randrange(10**6):x}" for _ in range(100)] for i in range(1000)}
    texts = [" . ".join(rnd.choice(many[f"c{rnd.randrange(1000)}"]) for _ in range(20)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, text string, concept string")
    whole = sorted(map(tuple, concepts.matches(df, "text", many, ["i"]).collect()))
    assert len(whole) >= 600 and {w[0] for w in whole} == set(range(30))
    monkeypatch.setattr(concepts, "PART_CHARS", 400_000)
    assert sorted(map(tuple, concepts.matches(df, "text", many, ["i"]).collect())) == whole
    few = {c: (w[:2], w[:1]) for c, w in list(many.items())[:3]}
    by = {r.concept: (r.full, r.bare) for r in concepts.concept_hits(df, "text", few, []).collect()}
    assert by == {c: tuple(sum(len(_pattern(w).findall(t or "")) for t in texts) for w in pair) for c, pair in few.items()}


def test_texts_of_very_many_matches_are_given_out_in_blocks(spark, tmp_path, monkeypatch):
    """A text is not copied for each of its matches, and rows of one doc_id have their own counts."""
    with monkeypatch.context() as m:
        seen = []
        m.setattr(concepts, "_passes", lambda df, text, dictionary, tails, run, schema: seen.append(run))
        concepts.matches(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "text", {"a": ["the"]}, ["doc_id"])
        batch = pa.record_batch({"doc_id": pa.array([1]), "_text": pa.array(["the " * 30_000])})
        sizes = [b.num_rows for b in seen[0](SimpleNamespace(value=({"a": ["the"]}, {})))(iter([batch]))]
        assert sizes == [10_000] * 3 and pa.default_memory_pool().max_memory() < 500_000_000
    texts = [(1, "the " * 60_000), (2, None), (3, "those things of THE"), (3, "the"), (None, "th other")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = {"a": ["the", "those things"], "none": ["zq"]}
    by = concepts.matches(df, "text", words, ["doc_id"]).groupBy("doc_id", "concept").agg(F.count("*").alias("n"), F.sum("start").alias("s"))
    assert sorted(map(tuple, by.collect())) == [(1, "a", 60_000, 4 * 60_000 * 59_999 // 2), (3, "a", 3, 16)]
    rows = [tuple(r) for r in concepts.covered(df, "text", words, ["doc_id"]).collect()]
    assert sorted(r[2:] for r in rows if r[1] == "a") == [(0, 0), (0, 0), (1, 3), (2, 15), (60_000, 180_000)] and [r[2:] for r in rows if r[1] == "none"] == [(0, 0)] * 5
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["f17_concept_matcher"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, 60_000, 180_000), (2, 0, 0), (3, 2, 15), (3, 1, 3), (None, 1, 2)], key=str)


def test_wordings():
    assert concepts.wordings(["of", "heart", "ab", "Kidney"], ["hr"], stop=["kidney"]) == ["heart", "hr"]
    assert concepts.wordings(["of"], name="thing") == ["thing"]


# ---- probe
def _plain_probe(x, y, pair, fold, components, c, permutations, seed):
    labels = y[:, None] ^ probe.coins(pair, permutations, seed)
    said = np.zeros(labels.shape, int)
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        mean, sd = x[tr].mean(0), x[tr].std(0)
        z, zt = (x[tr] - mean) / sd, (x[te] - mean) / sd
        basis = np.linalg.svd(z, full_matrices=False)[2][:components].T
        a, b = (np.column_stack((np.ones(len(v)), v @ basis)) for v in (z, zt))
        penalty = np.diag([0.0] + [1 / c] * components)
        for k in range(labels.shape[1]):
            w = np.zeros(components + 1)
            for _ in range(100):  # Newton's method
                p = 1 / (1 + np.exp(-a @ w))
                w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - labels[tr, k]) + penalty @ w)
            said[te, k] = b @ w > 0
    ok = said == labels
    pairs = np.array([ok[np.array(pair) == p].all(0) for p in sorted(set(pair))])
    return ok.mean(0), pairs.mean(0)


def test_probe_and_its_null_against_newton(spark):
    rng = np.random.default_rng(5)
    pairs, d = 60, 7
    pair = [f"p{i}" for i in range(pairs) for _ in range(2)]
    y = np.array([0, 1] * pairs)
    x = rng.normal(size=(2 * pairs, d)) * np.linspace(1, 3, d)
    x[:, 3] += 2.5 * y
    df = spark.createDataFrame([(p, int(v), r.tolist(), 1) for p, v, r in zip(pair, y, x)], "pair string, label int, x array<double>, fold int").drop("fold").repartition(3)
    got = probe.probe(df, folds=4, components=5, c=0.05, permutations=30).first()
    from counterlens.operators import sampling

    of = {r.pair: r.fold for r in sampling.grouped_folds(df, "pair", 4).collect()}
    accuracy, consistency = _plain_probe(x, y, pair, np.array([of[p] for p in pair]), 5, 0.05, 30, 0)
    assert (got.n, got.pairs) == (120, 60) and (got.accuracy, got.consistency) == (pytest.approx(accuracy[0]), pytest.approx(consistency[0]))
    assert (got.null_accuracy, got.null_consistency) == (pytest.approx(accuracy[1:].mean()), pytest.approx(consistency[1:].mean()))
    assert got.p_consistency == pytest.approx((1 + (consistency[1:] >= consistency[0]).sum()) / 31) and got.p_accuracy == pytest.approx((1 + (accuracy[1:] >= accuracy[0]).sum()) / 31)
    assert got.consistency > got.null_consistency and got.p_consistency == pytest.approx(1 / 31)
    # permutations keep one of each label in a pair, so a constant answer has no consistent pair
    c = probe.coins(["a", "b"], 600, 0)
    assert c.shape == (2, 601) and not c[:, 0].any() and 200 < c[0].sum() < 400 and (c[0] != c[1]).any()


def test_probe_of_nothing(spark):
    with pytest.raises(ValueError):
        probe.probe(spark.createDataFrame([], "pair string, label int, x array<double>"), folds=2)


# ---- retrieval
def test_nearest_over_several_blocks_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (120, 5)).astype(float)
    v[v.any(1) == 0] = 1.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    monkeypatch.setattr(retrieval, "BLOCK_ENTRIES", 100)
    for absolute, unit in ((False, False), (True, True)):
        got = sorted((r.query_id, r.id, r.sim) for r in retrieval.nearest(df.where("i % 10 = 0"), df, "i", "v", 4, absolute, unit).collect())
        u = v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v
        want = []
        for q in range(0, 120, 10):
            s = (np.abs(u @ u[q]) if absolute else u @ u[q]).round(6)
            want += [(q, int(i), float(s[i])) for i in sorted(range(120), key=lambda i: (-s[i], -i))[:4]]
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)])
    assert retrieval.nearest(df.limit(0), df, "i", "v", 2).count() == 0


def test_passages_by_blocks_and_steps_against_all_products(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 40}x"
    corpus = [(f"c{i:03d}", " ".join(word() for _ in range(rnd.randrange(0, 12)))) for i in range(90)]
    asked = [(i, " ".join(word() for _ in range(rnd.randrange(0, 9)))) for i in range(40)]
    p, q = spark.createDataFrame(corpus, "id string, text string"), spark.createDataFrame(asked, "q long, text string")
    whole = sorted(map(tuple, retrieval.top_passages(q, p, "q", "id", 5).collect()))
    # all products of the same vectors
    vec = {}
    for r in retrieval.tfidf(p, "id", "text").collect():
        vec.setdefault(r.key, {})[r.term] = (r.idf, r.w)
    idf = {t: i for v in vec.values() for t, (i, _) in v.items()}
    for k, text in asked:
        words = text.split()
        tf = {}
        for t in words + [" ".join(b) for b in zip(words, words[1:])]:
            if t in idf:
                tf[t] = tf.get(t, 0) + 1
        raw = {t: (1 + np.log(n)) * idf[t] for t, n in tf.items()}
        norm = np.sqrt(sum(x * x for x in raw.values())) or 1.0
        s = {c: round(sum(x / norm * vec.get(c, {}).get(t, (0, 0))[1] for t, x in raw.items()), 9) for c, _ in corpus}
        want = sorted(s, key=lambda c: (s[c], c), reverse=True)[:5]
        got = [r for r in whole if r[0] == k]
        assert [r[3] for r in got] == pytest.approx([s[c] for c in want], abs=1e-8) and [r[2] for r in got] == want
    monkeypatch.setattr(retrieval, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(retrieval, "STEP", 4)
    monkeypatch.setattr(retrieval, "PRODUCTS", 50)
    assert sorted(map(tuple, retrieval.top_passages(q, p, "q", "id", 5).collect())) == whole


# ---- formulas
def test_inverses_against_bisection(spark):
    rnd = random.Random(8)
    rows = [(k, float(rnd.choice([3, 15, 30, 45, 60, 90, 140, 900, 3000])), rnd.randrange(18, 95), rnd.choice(["male", "female"]), float(rnd.randrange(40, 120)), rnd.choice([None, float(rnd.randrange(145, 200))])) for k in ("mdrd", "ckd_epi", "cockcroft_gault") for _ in range(60)]
    df = spark.createDataFrame(rows, "kind string, target double, age int, sex string, kg double, cm double")
    cols = [F.col(c) for c in ("age", "sex", "kg", "cm")]
    got = df.withColumn("scr", clinical.solve_creatinine(F.col("kind"), F.col("target"), *cols))
    ends = got.withColumns({n: clinical.compute(F.col("kind"), F.lit(x), *cols) for n, x in (("low", 0.05), ("high", 60.0))}).withColumn("back", clinical.compute(F.col("kind"), F.col("scr"), *cols))
    seen = ends.collect()
    assert all((r.scr is None) == (not r.high <= r.target <= r.low) for r in seen) and {r.scr is None for r in seen} == {True, False}
    assert all(r.back == pytest.approx(r.target, abs=1e-6) for r in seen if r.scr is not None)
    assert df.limit(1).select(clinical.solve_creatinine(F.lit("other"), F.col("target"), *cols)).first()[0] is None
