from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from counterlens.functions import adaptive, binomial, clinical, spans
from counterlens.operators import conformal, gates, inference, metrics, ordered, retrieval
from counterlens.sources import files
from counterlens.streaming import monitors


def tau(spark, u, ok, rule="conformal", alpha=0.1, delta=0.1):
    rows = [("k", float(x), bool(y), i) for i, (x, y) in enumerate(zip(u, ok))]
    out = conformal.calibrate(spark.createDataFrame(rows, "g string, u double, ok boolean, seq long"), ["g"], alpha, delta, rule).collect()
    return out[0].tau if out else float("-inf")


def test_fewest_items_that_certify():
    assert [conformal.min_certifiable_n(0.1, d) for d in (0.2, 0.1, 0.05)] == [16, 22, 29]


def test_thresholds(spark):
    assert tau(spark, [i / 7 for i in range(60)], [True] * 60) == 59 / 7
    assert tau(spark, [1.0, 2.0], [False] * 2) == float("-inf") == tau(spark, [], [])
    assert tau(spark, [3.0] * 21, [True] * 21) == float("-inf") and tau(spark, [3.0] * 22, [True] * 22) == 3.0
    # a later set may certify although an earlier one does not
    assert tau(spark, [0.1] + [0.2] * 60, [False] + [True] * 60) == 0.2
    assert tau(spark, [1.0, 2.0, 3.0, 4.0], [True, False, True, False], "legacy", 0.4) == 3.0
    assert tau(spark, [2.0, 5.0], [False] * 2, "legacy") == 2.0
    with pytest.raises(ValueError):
        tau(spark, [0.1], [True], "other")


def test_stricter_confidence_never_retains_more(spark):
    rnd = np.random.default_rng(0)
    u, ok = rnd.random(200).round(2), rnd.random(200) < 0.95
    taus = [tau(spark, u, ok, delta=d) for d in (0.3, 0.1, 0.02)]
    assert taus == sorted(taus, reverse=True)


@given(st.integers(1, 60), st.data())
@settings(max_examples=60, deadline=None)
def test_upper_limit_solves_the_binomial_tail(n, data):
    k = data.draw(st.integers(0, n))
    u = binomial.upper([k], [n], [0.1])[0]
    assert u >= k / n
    if k < n:
        assert sum(comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(k + 1)) == pytest.approx(0.1, abs=1e-9)


def test_tails_of_large_counts_against_whole_numbers():
    for n, k in ((10_000, 4_900), (10_000, 5_100), (5_282, 6), (9_999, 9_998), (20_000, 9_000)):
        exact = Fraction(sum(comb(n, i) for i in range(k + 1)), 2**n)
        assert binomial.tail([k], [n], [0.5])[0] == pytest.approx(float(exact), rel=1e-9, abs=1e-300)
    assert binomial.tail([-1, 3, 0], [3, 3, 3], [0.2, 0.2, 0.2]).tolist() == pytest.approx([0, 1, 0.512])
    cdf = np.cumsum([comb(500, i) * 0.3**i * 0.7 ** (500 - i) for i in range(501)])
    assert [binomial.quantile([q], [500], [0.3])[0] for q in (0.025, 0.5, 0.975)] == [int(np.argmax(cdf >= q)) for q in (0.025, 0.5, 0.975)]
    assert binomial.quantile([0.5, 0.5], [10, 10], [0.0, 1.0]).tolist() == [0, 10]


def test_mcnemar_of_many_discordant_rows(spark):
    rows = spark.range(5282).select((F.col("id") >= 6).alias("after"))
    got = inference.mcnemar(rows.withColumn("before", ~F.col("after")), F.col("before"), F.col("after"), []).first()
    assert (got.b01, got.b10) == (5276, 6) and got.p_value < 1e-300
    even = inference.mcnemar(spark.createDataFrame([(True, True)], "before boolean, after boolean"), F.col("before"), F.col("after"), []).first()
    assert (even.b01, even.b10, even.p_value) == (0, 0, 1.0)


def _area(score, wrong):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    p = wrong.sum()
    return (rank[wrong].sum() - p * (p + 1) / 2) / (p * (len(score) - p))


def test_bootstraps_resample_units(spark, monkeypatch):
    """Against plain resampling of rows and clusters; the cut of scores into ranges changes nothing."""
    rnd = np.random.default_rng(3)
    wrong = rnd.random(400) < 0.3
    a, b = (rnd.normal(size=400) + 0.8 * wrong).round(1), rnd.normal(size=400).round(1)
    df = spark.createDataFrame([("g", float(x), float(y), bool(w), int(i % 40)) for i, (x, y, w) in enumerate(zip(a, b, wrong))], "g string, a double, b double, w boolean, c int")
    idx = rnd.integers(0, 400, (1500, 400))
    drawn = np.array([(_area(a[i], wrong[i]), _area(b[i], wrong[i])) for i in idx])
    one = inference.auroc_interval(df, "a", F.col("w"), ["g"], 1500).first()
    assert one.auroc == pytest.approx(_area(a, wrong)) and [one.lo, one.hi] == pytest.approx(np.quantile(drawn[:, 0], [0.025, 0.975]).tolist(), abs=0.012)
    two = inference.paired_delta(df, "a", "b", F.col("w"), ["g"], 1500).first()
    assert two.n == 400 and two.delta == pytest.approx(_area(a, wrong) - _area(b, wrong)) and [two.lo, two.hi] == pytest.approx(np.quantile(drawn[:, 0] - drawn[:, 1], [0.025, 0.975]).tolist(), abs=0.02)
    monkeypatch.setattr(inference, "CELLS_A_TASK", 20)
    again = inference.paired_delta(df, "a", "b", F.col("w"), ["g"], 1500).first()
    assert [again.lo, again.hi, again.delta, again.p] == pytest.approx([two.lo, two.hi, two.delta, two.p])
    c = np.arange(400) % 40
    s, n = np.bincount(c, wrong), np.bincount(c)
    pick = rnd.integers(0, 40, (4000, 40))
    got = inference.cluster_interval(df, "c", F.col("w"), ["g"], 4000).first()
    assert [got.lo, got.hi] == pytest.approx(np.quantile(s[pick].sum(1) / n[pick].sum(1), [0.025, 0.975]).tolist(), abs=0.012)
    flags = inference.mean_interval(df, F.col("w"), ["g"]).first()
    assert [flags.lo, flags.hi] == pytest.approx(np.quantile(wrong[idx].mean(1), [0.025, 0.975]).tolist(), abs=0.008)
    few = inference.difference_interval(spark.createDataFrame([(1, 9, 3, 20), (30, 100, 60, 100)], "k1 int, n1 int, k2 int, n2 int"), []).collect()
    assert few[0].lo is None and few[1].lo < -0.3 < few[1].hi < 0


def test_running_sums_and_places_do_not_depend_on_ranges(spark):
    rnd = np.random.default_rng(4)
    rows = [(["x", None][int(g)], float(round(v, 1)) + 0.0, i, int(n)) for i, (g, v, n) in enumerate(zip(rnd.integers(0, 2, 300), rnd.normal(size=300), rnd.integers(0, 9, 300)))]
    df = spark.createDataFrame(rows, "g string, v double, i int, n int")
    want = {}
    for g in ("x", None):
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += r[3]
            want[r[2]] = total
    got = ordered.running(df, ["g"], ["v", "i"], {"s": "n"}, total="m").collect()
    assert {r.i: r.s for r in got} == want and {(r.g, r.m) for r in got} == {(g, sum(r[0] == g for r in rows)) for g in ("x", None)}
    placed = ordered.numbered(df.withColumn("h", F.col("i") * 997 % 1000003), [], ["h", "i"], ranges=5).collect()
    assert sorted((r.h, r.place) for r in placed) == [(h, k + 1) for k, h in enumerate(sorted(i * 997 % 1000003 for i in range(300)))]


def test_clinical_gate_declines(spark):
    notes = ["A 60-year-old man on metformin. Creatinine 2.1 mg/dL and later creatinine 3.3 mg/dL.", "A 60-year-old man on metformin, creatinine 2.1.", "His wife says her metformin stays, creatinine 2.1 mg/dL, aged 60.", "A 60-year-old man on metformin. Cr 2.9 mg/dL.", "cr 2.9 mg/dL, metformin, 60-year-old man", "ondansetron, QT 480 ms, pulse 10 bpm", None, "nothing of note"]
    got = [(r.fired, r.declined) for r in gates.clinical_gate(spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, note string").coalesce(1), "note").orderBy("i").collect()]
    assert got == [(False, "creatinine_mgdl"), (False, "creatinine_mgdl"), (False, "sex"), (True, None), (False, "creatinine_mgdl"), (False, "implausible"), (False, "no drug"), (False, "no drug")]


def test_retrieval_over_several_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"word{i % 7} term{i % 5} alpha beta{i}") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(1, "word3 term2 alpha"), (2, "nothing known"), (3, None), (4, "alpha beta7 beta7")], "q long, text string")
    whole = sorted(map(tuple, retrieval.top_passages(asked, corpus, "q", "id").collect()))
    monkeypatch.setattr(retrieval, "BLOCK_ENTRIES", 60)
    assert sorted(map(tuple, retrieval.top_passages(asked, corpus, "q", "id").collect())) == whole
    assert [(r[0], r[2]) for r in whole if r[0] in (2, 3)] == [(2, 39), (2, 38), (2, 37), (3, 39), (3, 38), (3, 37)] and next(r for r in whole if r[0] == 4)[2] == 7


def test_a_report_is_never_cut(spark):
    with pytest.raises(ValueError):
        files.report(spark.range(20), limit=19)
    assert len(files.report(spark.range(20), limit=20).split("\n")) == 22


def test_scores_of_a_hand_made_table(spark):
    rows = [("p1", "SAFE", "SAFE", False, None), ("p1", "UNSAFE", "UNSAFE", False, None), ("p2", "SAFE", "SAFE", False, False), ("p2", "UNSAFE", "SAFE", False, False), ("p3", "SAFE", None, False, False), ("c1", "SAFE", "SAFE", False, True), ("c1", "SAFE", "UNSAFE", False, True), ("p4", "UNSAFE", "SAFE", True, False), ("p4", "SAFE", "SAFE", False, False)]
    got = metrics.score(spark.createDataFrame([("v", *r) for r in rows], "v string, pair_id string, label string, pred string, abstained boolean, is_control boolean"), ["v"]).first()
    assert (got.n, got.n_pairs, got.n_control_pairs) == (9, 3, 1)
    assert got.accuracy == pytest.approx(5 / 9) and got.selective_accuracy == pytest.approx(5 / 7) and got.violation_rate == pytest.approx(1 / 3)
    assert got.causal_consistency == pytest.approx(1 / 3) and got.causal_flip_rate == 0.5 and got.spurious_flip_rate == 1.0 and got.discrimination == -0.5


def test_adaptive_threshold_batch_and_stream_agree(spark, tmp_path):
    """Every batch by a query of its own, which goes on from the checkpoint; and against the fold with all values held."""
    rnd = np.random.default_rng(2)
    rows = [(s, i, float(rnd.random()) if rnd.random() > 0.1 else None, bool(rnd.random() < 0.8)) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "stream string, seq long, u double, ok boolean")
    want = {(r.stream, r.seq): r.tau for r in monitors.adaptive_batch(df).collect()}
    for name in "ab":
        seen, level = [], 0.1
        for _, i, u, ok in (r for r in rows if r[0] == name):
            tau = float("inf") if len(seen) < 8 else float(np.quantile(seen, min(max(1 - level, 0), 1)))
            assert want[name, i] == pytest.approx(tau)
            u = float("inf") if u is None else u
            level = float(np.clip(level + 0.05 * (0.1 - float(u <= tau and not ok)), 1e-4, 0.999))
            seen += [u] if np.isfinite(u) else []
    df.limit(0).write.parquet(str(tmp_path / "in"))
    with monitors.state_store(spark):
        for part in range(3):
            df.where(f"seq >= {20 * part} AND seq < {20 * part + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = monitors.adaptive_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
            run = stream.writeStream.foreachBatch(monitors.once_per_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    got = {(r.stream, r.seq): r.tau for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and all(want[k] == got[k] for k in want)
    assert sum(t == float("inf") for t in want.values()) >= 16


@given(st.lists(st.integers(0, 30), min_size=1, max_size=200), st.sampled_from([2, 8, 1000]))
@settings(max_examples=150, deadline=None)
def test_ordered_values_keep_their_ranks_in_bounded_room(values, capacity):
    held = adaptive.OrderedValues(capacity)
    for k, x in enumerate(values):
        held.add(float(x))
        if k % 7 == 0:  # as a state store would
            held = adaptive.OrderedValues(capacity, {i: np.array(v) for i, v in held.levels.items()}, held.turns)
    assert held.n == len(values) and all(len(v) < capacity for v in held.levels.values())
    ordered_, bound = sorted(values), held.n * max(0.0, np.log2(held.n / capacity)) / capacity + (1 if held.n >= capacity else 0)
    for rank in range(held.n):
        x = held.at(rank)
        first, last = np.searchsorted(ordered_, x), np.searchsorted(ordered_, x, "right") - 1
        assert first - bound <= rank <= last + bound


def test_state_of_a_million_values_is_small():
    fold = adaptive.AdaptiveThreshold()
    u = np.random.default_rng(0).random(1_000_000)
    for x in u.tolist():
        fold.seen.add(x)
    size = sum(8 * len(v) for v in fold.seen.levels.values())
    assert size <= 8 * adaptive.CAPACITY * (1 + np.log2(1_000_000 / adaptive.CAPACITY)) and fold.seen.n == 1_000_000
    ordered_ = np.sort(u)
    worst = max(abs(np.searchsorted(ordered_, fold.seen.at(r)) - r) for r in range(0, 1_000_000, 9973))
    assert worst <= 1_000_000 * np.log2(1_000_000 / adaptive.CAPACITY) / adaptive.CAPACITY


def test_creatinine_inverse_agrees_with_bisection(spark):
    grid = spark.createDataFrame([(t, a, s) for t in (20.0, 45.0, 90.0, 130.0) for a in (20, 60, 85) for s in ("female", "male")], "t double, age int, sex string")
    back = grid.select("t", clinical.ckd_epi(clinical.ckd_epi_inverse(F.col("t"), F.col("age"), F.col("sex")), F.col("age"), F.col("sex")).alias("v")).collect()
    assert all(r.v == pytest.approx(r.t, abs=1e-9) for r in back)


def test_mentions_and_locations():
    assert [m[:2] + (round(m[6], 3),) for m in spans.mentions("Creatinine 1.4 mg/dL, later Cr 176.8 umol/L; Cr 9 and creatine 5 mmol/L")] == [(1.4, "mg/dL", 1.4), (176.8, "umol/L", 2.0)]
    assert spans.places("12.5 of 112.5 or 12.55", 12.5) == {(0, 4)} and spans.places("12.0", 12.0) == {(0, 2), (0, 4)} and spans.places("3.140", 3.14) == {(0, 5)}


def test_files(spark, tmp_path):
    bad = str(tmp_path / "x.jsonl")
    with open(bad, "w") as f:
        f.write('{"id": "a", "n": 1}\n{broken\n')
    loose = files.read_jsonl(spark, bad, "id string, n long", strict=False).collect()
    assert sorted(r._corrupt is not None for r in loose) == [False, True]
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, "id string, n long").collect()
    np.savez(tmp_path / "a.npz", w=np.arange(6.0).reshape(3, 2), ids=np.arange(3))
    rows = files.read_arrays(spark, str(tmp_path / "a.npz"), ["w", "ids"]).orderBy("name", "row").collect()
    assert [r.x for r in rows if r.name == "w"] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]] and len(rows) == 6
    assert files.read_artifact(spark, [str(tmp_path / "none.json")], required=False) is None
    with pytest.raises(FileNotFoundError):
        files.read_artifact(spark, [str(tmp_path / "none.json")])
    old = spark.createDataFrame([("a", 1, False)], "k string, n int, mock boolean")
    with pytest.raises(ValueError):
        files.merge_summary(old, spark.createDataFrame([("a", 2, True)], old.schema), ["k"], F.col("mock"))
    cache = files.CachedClient(spark.createDataFrame([(files.CachedClient.key("/s", {"b": "2", "a": "1", "apiKey": "z"}), None)], "key string, body string"))
    assert cache.lookup(spark.createDataFrame([("/s?a=1&b=2",)], "key string")).first().body is None
    with pytest.raises(LookupError):
        cache.lookup(spark.createDataFrame([("/t?",)], "key string")).collect()
