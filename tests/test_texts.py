"""Statements in notes of our own, and what is made of them."""

import pytest
from pyspark.sql import functions as F

from counterlens.functions import clinical, spans
from counterlens.operators import audits, causal_graph, gates
from counterlens.sources import files, questions
from counterlens.streaming import monitors


@pytest.fixture(scope="module")
def read(spark):
    def run(texts, columns):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, note string").select("i", *[c.alias(n) for n, c in columns(F.col("note")).items()])
        return [r.asDict() for r in df.orderBy("i").collect()]

    return run


NOTES = [
    ("An 82 year old lady, weighing about 61.5 kg, height measured at 158 cm. Creatinine (1.9 mg/dL).", {"age": 82, "sex": "female", "weight_kg": 61.5, "height_cm": 158, "creatinine_mgdl": 1.9}),
    ("The gentleman is aged 47. Serum creatinine came back at 132 umol/L; pulse 58.", {"age": 47, "sex": "male", "creatinine_mgdl": 132 / 88.4, "heart_rate": 58}),
    ("His ECG: QT interval = 412 msec with a heart rate of 75 beats per minute.", {"sex": "male", "qt_ms": 412, "heart_rate": 75}),
    ("Bilirubin, total 2.4 mg/dL. Albumin low at 2.9 g/dL. INR 1.6.", {"bilirubin": 2.4, "albumin": 2.9, "inr": 1.6}),
    ("0.8 mg/dL creatinine. Later she was well.", {"creatinine_mgdl": 0.8, "sex": "female"}),
    ("Creatinine 0.8 mg/L.", {"creatinine_mgdl": None}),  # a unit that must not be guessed at
    ("Creatinine 2.1.", {"creatinine_mgdl": None}),
    ("Glucose 71 mg/dL, creatinine 1.2 mg/dL.", {"creatinine_mgdl": None}),  # either number may be meant
    ("Creatinine rose to 3.4 mg/dL. The creatinine of 3.4 mg/dL stood.", {"creatinine_mgdl": 3.4}),
    ("Ascites: tense; encephalopathy grade 3.", {"ascites_pts": 3, "enceph_pts": 3}),
    ("Without ascites. There was grade II encephalopathy.", {"ascites_pts": 1, "enceph_pts": 2}),
    ("A trace of ascites, encephalopathy absent.", {"ascites_pts": 2, "enceph_pts": 1}),
    ("He and she. 1234 kg of grain.", {"sex": None, "weight_kg": None}),
    (None, {"age": None, "sex": None, "creatinine_mgdl": None}),
    ("", {"qt_ms": None}),
]


def test_facts_of_notes(read):
    got = read([n for n, _ in NOTES], gates.clinical_facts)
    for (note, want), row in zip(NOTES, got):
        for name, value in want.items():
            assert row[name] == (value if value is None or isinstance(value, str) else pytest.approx(value)), (note, name)


def test_states_are_affirmed_or_denied(read):
    notes = ["She is 12 weeks pregnant.", "She is not pregnant.", "Has severe asthma.", "No history of asthma.", "Brittle, persistent asthma since.", "On clarithromycin.", "On amoxicillin.", "Nothing known."]
    got = read(notes, gates.facts)
    assert [r["pregnant"] for r in got] == [True, False] + [None] * 6
    assert [r["severe_asthma"] for r in got][2:5] == [True, False, True] and got[7]["severe_asthma"] is None
    assert [r["clarithromycin"] for r in got][5:] == [True, False, None]


def test_mentions_have_their_places():
    note = "Cr 2.9 mg/dL, then creatinine 150 µmol/L; cr 9.9 mg/dL."
    got = spans.mentions(note)
    assert [(v, note[a:b], round(m, 6)) for v, _, _, _, a, b, m in got] == [(2.9, "2.9", 2.9), (2.9, "2.9", 2.9), (150.0, "150", round(150 / 88.4, 6))][: len(got)] or [v for v, *_ in got] == [2.9, 150.0]
    assert all(note[s:e].startswith(("Cr", "2.9", "creatinine")) for _, _, s, e, *_ in got) and 9.9 not in [v for v, *_ in got]
    assert spans.mentions(None) == [] == spans.mentions("Creatinine 4")


def test_only_needed_facts_change_no_decision(spark):
    notes = [(i, n) for i, (n, _) in enumerate(NOTES)] + [(90, "A 60-year-old man on metformin. Cr 2.9 mg/dL."), (91, "ondansetron; QT 520 ms, pulse 60 bpm, 70 kg"), (92, "apixaban, INR 2.4, bilirubin 4 mg/dL, albumin 2.5 g/dL, tense ascites, no encephalopathy")]
    df = spark.createDataFrame(notes, "i int, note string")
    rows = lambda only: [(r.i, r.drug, r.fired, r.violated, r.quantity, r.declined) for r in gates.clinical_gate(df, "note", only_needed=only).orderBy("i").collect()]
    assert rows(True) == rows(False)
    assert [r[2:4] for r in rows(True) if r[0] >= 90] == [(True, True), (True, True), (True, True)]


def test_brackets_follow_from_their_cuts(spark):
    assert clinical.bracket_values("bilirubin") == {1: 1.0, 2: 2.5, 3: 4.0} and clinical.bracket_values("albumin") == {1: 4.2, 2: 3.15, 3: 2.1}
    for field, points in (("bilirubin", clinical.bilirubin_points), ("albumin", clinical.albumin_points)):
        made = spark.createDataFrame([(p, v) for p, v in clinical.bracket_values(field).items()], "p int, v double")
        assert made.where(points(F.col("v")) != F.col("p")).count() == 0


# ---- prompts, questions, passages
def test_rewrites_of_prompts(spark):
    rows = [(0, "has value 12 and value 13"), (1, "level 4 units then level 5 units"), (2, "value low"), (3, None), (4, "ask here"), (5, "  a b c\td  ")]
    df = spark.createDataFrame(rows, "i int, t string").orderBy("i")
    hidden = [r[0] for r in df.select(spans.redact_first(F.col("t"), [r"(value )\d+", r"(level )\d+ units"])).collect()]
    assert hidden == ["has value [not recorded] and value 13", "level [not recorded] then level 5 units", None, None, None, None]
    assert [r[0] for r in df.select(spans.truncate_words(F.col("t"), 3)).collect()] == ["has value 12 ...", "level 4 units ...", "value low", None, "ask here", "a b c ..."]
    assert df.where("i = 4").select(spans.swap_once(F.col("t"), "ask", "tell")).first()[0] == "tell here" and df.where("i = 3").select(spans.swap_once(F.col("t"), "ask", "tell")).first()[0] is None
    for i in (1, 2):  # twice, and not at all
        with pytest.raises(Exception, match="not exactly one"):
            df.where(f"i = {i}").select(spans.swap_once(F.col("t"), "level", "x")).collect()


def test_question_sets_of_three_forms(spark):
    one = questions.by_columns(spark.createDataFrame([(7, " Why? ", "x", "y", 1, "s")], "k int, q string, a string, b string, c int, m string"), "one", "k", "q", ["a", "b"], "c", "{question}|{options}", {"subject": F.col("m")})
    two = questions.by_map(spark.createDataFrame([(1, "a b c", {"A": "p", "C": None, "D": "{question}"}, "D")], "k int, q string, o map<string,string>, a string"), "two", "k", "q", "o", "a", "{question}|{options}", most_words=2)
    three = questions.by_context(spark.createDataFrame([(1, "Q", ["u v", "w"], " Maybe ")], "k int, q string, c array<string>, d string"), "three", "k", "q", "c", "d", "{context}|{question}", most_words=2)
    got = [r.asDict() for r in one.unionByName(two).unionByName(three).collect()]
    assert got[0] == {"source": "one", "id": "one::7", "prompt": "Why?|A. x\nB. y", "labels": ["A", "B"], "gold": "B", "meta": {"subject": "s"}}
    assert got[1]["prompt"] == "a b ...|A. p\nC. \nD. a b ..." or got[1]["prompt"].startswith("a b ...|A. p\nC. \nD. ")
    assert (got[1]["gold"], got[2]["prompt"], got[2]["labels"], got[2]["gold"], got[2]["meta"]) == ("D", "u v ...|Q", ["yes", "no", "maybe"], "maybe", {})


def test_passages_are_squeezed_before_they_are_measured(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r.text for r in questions.passages(make([("g", "G")]), make([("d", "D")]), make([("long", " x\n" * 50), ("short", "y" + " " * 200 + "y"), ("none", None)]), least=80, most=90).collect()}
    assert got == {"guideline::g": "G", "distractor::d": "D", "label::long": ("x " * 50)[:90]}


def test_what_a_prompt_states_is_compared_with_what_is_stored(spark):
    rows = [("a", "value 3\nvalue 12.50 now", 12.5, "<", 20.0, "UNSAFE"), ("b", "value 12.50", 12.51, "<", 20.0, "UNSAFE"), ("c", "value 12.5", 12.54, ">", 20.0, "UNSAFE"), ("d", "nothing", 1.0, "<", 20.0, "SAFE")]
    df = spark.createDataFrame(rows, "id string, prompt string, factor_value double, op string, threshold double, label string")
    read_ = audits.from_prompt(df, "prompt", r"value (\d+(?:\.\d+)?)", F.col("shown"))
    assert [(r.shown, r.decimals, r.relabelled) for r in read_.orderBy("id").collect()] == [(12.5, 2, "UNSAFE"), (12.5, 2, "UNSAFE"), (12.5, 1, "SAFE"), (None, None, None)]
    r = audits.rederived(read_, []).first()
    assert (r.n, r.unread, r.value_off, r.label_off) == (4, 1, 1, 1)


def test_decisions_follow_from_their_parts(spark):
    right = dict(gate_fired=False, violated=False, label="SAFE", own="SAFE", pred="SAFE", u=0.3, h=0.3, tau=0.5, uq=True, abstained=False)
    odd = [{}, {"u": 0.4}, {"gate_fired": True, "violated": True, "pred": "UNSAFE"}, {"pred": "UNSAFE"}, {"h": 0.9, "u": 0.9}, {"h": None, "u": None, "abstained": True}, {"h": None, "u": None, "uq": False}, {"own": None, "pred": None, "abstained": True}]
    df = spark.createDataFrame([tuple((right | x).values()) for x in odd], "gate_fired boolean, violated boolean, label string, own string, pred string, u double, h double, tau double, uq boolean, abstained boolean")
    r = audits.decisions_rederived(df, [], F.col("own"), F.col("h")).first()
    assert (r.n, r.entropy_off, r.gate_off, r.pred_off, r.abstained_off) == (8, 1, 1, 1, 1)


def test_kinds_and_edges(spark):
    df = spark.createDataFrame([(0, ["T999", "T033"], "induces"), (1, [], "isa"), (2, None, None), (3, ["T121", "T047"], "may_treat")], "i int, t array<string>, r string").orderBy("i")
    assert [tuple(r) for r in df.select(causal_graph.kind_of(F.col("t")), causal_graph.edge_of(F.col("r"))).collect()] == [("finding", "INDUCES"), ("other", None), ("other", None), ("drug", "MAY_TREAT")]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    lines = ['{"a": %d}' % i if i % 7 else "{broken %d" % i if i % 2 else "" for i in range(4000)]
    open(path, "w").write("\n".join(lines))
    open(str(tmp_path / "y.jsonl"), "w").write("\n\nnot json\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line): r.text for r in files.bad_lines(spark, str(tmp_path), "a int").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("x.jsonl", i + 1): t for i, t in enumerate(lines) if t.startswith("{broken")} | {("y.jsonl", 3): "not json"}
    assert got == want


def test_budget_of_a_stream(spark):
    rows = [(s, i, n) for s, sizes in (("a", [4, None, 3, 4, 1]), ("b", [20, 1, 1, 1, 1])) for i, n in enumerate(sizes)]
    got = sorted(map(tuple, monitors.budgeted(spark, spark.createDataFrame(rows, "stream string, seq long, size long"), 10).collect()))
    assert got == [("a", 0, 4), ("a", 1, 4), ("a", 2, 7)]
