import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from counterlens.llm import bpe_prefix, divergence, graph, hard_negatives, hnsw, kernel, language_id, line_dedup, merging, mixing, near_dedup, page_text, sharding, substring_dedup, token_shards, transport_stream
from counterlens.llm.shared import Scratch

TEXTS = st.lists(st.one_of(st.none(), st.text("ab é\n\t\r\x0b,.' 　中\x1c", max_size=30)), max_size=8)
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_match_the_pattern(texts):
    buf, offs = kernel.utf8(pa.array(texts, pa.string()))
    starts, ends, first = kernel.words(buf, offs)
    found = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [brute.WORD.findall(t or "") for t in texts]
    h = kernel.hash_segments(buf, starts, ends)
    assert len(set(h.tolist())) == len(set(found))


@given(st.lists(st.one_of(st.integers(0, 1 << 22), st.integers(0, 1 << 40)), min_size=1))
@settings(max_examples=100, deadline=None)
def test_gaps_round_trip(values):
    values = np.sort(np.array(values))
    assert np.array_equal(kernel.unpack_gaps(kernel.pack_gaps(values)), values)


# ---- 1: token shards
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), unique=True, max_size=300))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_is_minimal_and_knows_absent_keys(keys):
    keys = np.array(sorted(keys), np.int64)
    ids = np.arange(3 * len(keys), dtype="<u2")
    shard = token_shards.Shard(token_shards.pack_shard(keys, 0, 3 * np.arange(1, len(keys) + 1), ids))
    assert sorted(shard.index.slots(keys.view(np.uint64)).tolist()) == list(range(len(keys)))
    assert shard.find(keys).tolist() == list(range(len(keys)))
    absent = np.setdiff1d(np.arange(-50, 50), keys)
    assert (shard.find(absent) == -1).all()


def _token_rows(df, scratch):
    manifest = token_shards.write_shards(df, scratch, WORD_BPE)
    return manifest, token_shards.read_shards(manifest, manifest.count()).collect()


def test_token_shards_against_the_tokenizer(spark, docs, corpus):
    from tokenizers import Tokenizer

    manifest, rows = _token_rows(docs, Scratch(spark, "t"))
    tokenizer, start, got = Tokenizer.from_file(WORD_BPE), 0, {r.doc_id: r for r in rows}
    assert len(rows) == len(corpus)
    for i, text, *_ in sorted(corpus):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        if i < 20:
            assert [x.tolist() for x in token_shards.lookup(manifest, i)] == [ids]
    assert token_shards.lookup(manifest, 2) == []


def test_token_shards_odd_rows(spark, odd_docs, no_docs):
    manifest, rows = _token_rows(odd_docs, Scratch(spark, "t"))
    assert len(rows) == 8 and sum(r.doc_id is None for r in rows) == 2
    assert sorted(r.start for r in rows) == sorted(np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)][:-1]]).tolist())
    assert len(token_shards.lookup(manifest, 1)) == 3
    assert _token_rows(no_docs, Scratch(spark, "t"))[1] == []


# ---- 2: mixing
def test_mix_against_brute_force(spark, docs, corpus):
    rows = mixing.plan(docs, Scratch(spark, "m")).collect()
    copies, target, total = brute.mix([(i, t, s) for i, t, _, s in corpus])
    source = {i: s for i, _, _, s in corpus}
    assert sorted((r.doc_id, x) for r in rows for x in r.takes if x) == sorted((i, x) for i, x, _ in copies)
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == total[source[r.doc_id]] and r.taken <= 2 * r.size
        assert all(0 <= p <= 1 for p, x in zip(r.positions, r.takes) if x)
    ordered = [r.position for r in mixing.training_order(mixing.plan(docs, Scratch(spark, "m"))).collect()]
    assert ordered == sorted(ordered)


def test_ranges_of_a_mix_change_nothing(spark, docs, monkeypatch):
    plain = sorted(map(str, mixing.plan(docs, Scratch(spark, "m")).collect()))
    monkeypatch.setattr(mixing, "RANGE_DIGITS", (0, 2))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted(map(str, mixing.plan(docs, Scratch(spark, "m")).collect())) == plain


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES.values():
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("s")).select("s", mixing.invert(knots, F.col("s")).alias("t")).collect()
        xs, ys = zip(*knots)
        grid = np.linspace(0, 1, 20001)
        area = np.concatenate(([0], np.cumsum(np.interp((grid[1:] + grid[:-1]) / 2, xs, ys)))) / np.interp((grid[1:] + grid[:-1]) / 2, xs, ys).sum()
        assert all(abs(np.interp(r.t, grid, area) - r.s) < 1e-4 for r in rows)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    assert mixing.plan(odd_docs, Scratch(spark, "m")).count() == 8
    assert mixing.plan(no_docs, Scratch(spark, "m")).collect() == []


# ---- 3: shards
def _check_shards(rows, shards):
    sizes = {i: [r for r in rows if r.shard == i] for i in range(shards)}
    counts = [len(x) for x in sizes.values()]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in sizes.values())


def test_shards_keep_groups_together(spark, docs, corpus):
    rows = sharding.shard(docs, Scratch(spark, "s"), shards=5).collect()
    _check_shards(rows, 5)
    text = {i: t for i, t, *_ in corpus}
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 8, zlib.crc32((text[r.doc_id] or "").encode())) for r in rows)
    homes = {}
    for r in rows:
        if text[r.doc_id] is not None:
            homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert max(map(len, homes.values())) == 1


def test_shards_split_a_group_too_large_for_one(spark, no_docs, odd_docs):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}", None, None) for i in range(300)]
    out = sharding.shard(spark.createDataFrame(rows, no_docs.schema), Scratch(spark, "s"), shards=8).collect()
    _check_shards(out, 8)
    _check_shards(sharding.shard(odd_docs, Scratch(spark, "s"), shards=3).collect(), 3)
    assert sharding.shard(no_docs, Scratch(spark, "s")).collect() == []


def test_overflowing_shards_cut_few_groups(spark, no_docs):
    """Most rows in groups that do not divide a shard: fewer groups are cut than there are shards, and none is scattered."""
    rows = [(i, f"g{i % 300}" if i < 21600 else f"s{i}", None, None) for i in range(24000)]
    out = sharding.shard(spark.createDataFrame(rows, no_docs.schema), Scratch(spark, "s")).collect()
    _check_shards(out, 24)
    homes = {}
    for r in out:
        if r.doc_id < 21600:
            homes.setdefault(r.doc_id % 300, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) < 24 and max(map(len, homes.values())) <= 2


def test_slots_of_groups_in_ranges(spark, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    monkeypatch.setattr(sharding, "HOT", 10)
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 40}", None, None) for i in range(400)] + [(5, "same", None, None)] * 3
    out = sharding.shard(spark.createDataFrame(rows, no_docs.schema), Scratch(spark, "s"), shards=5).collect()
    _check_shards(out, 5)
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)


# ---- 4: pages
@pytest.mark.parametrize("name", ["page no-sidebar", "content has-comments", "post social-share", "story header-large", "header-large"])
def test_a_wrapper_is_not_noise_by_one_word(name):
    body = "<p>" + "words of the story stand here " * 9 + "</p>"
    page = f"<html><body><nav>menu</nav><div class='{name}'>{body}<div class='comments'>a reader says so</div></div><footer>foot</footer></body></html>"
    assert page_text.read(page) == ("words of the story stand here " * 9).strip()


def test_reader_comments_longer_than_the_article_stay_out():
    assert page_text.read("<body><article><p>a short article</p></article><div class='comments'>" + "<p>a reader says much</p>" * 20 + "</div></body>") == "a short article"


STORY = "<p>" + "words of the story stand here " * 20 + "</p>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<article><h1 class='entry-header'>The title</h1>{STORY}</article>", "The title " + "words of the story stand here " * 20),
        (f"<article>{STORY}<section class='discussion'><h2>Discussion</h2><p>What this means is said here.</p></section></article>", "words of the story stand here " * 20 + "Discussion What this means is said here."),
        ("<article><p>Before <a class='related-word' href='/x'>the word</a> after.</p></article>", "Before the word after."),
        (f"<article>{STORY}<p class='advert'>Buy this now</p><span class='share'>Share</span></article>", "words of the story stand here " * 20),
        (f"<article>{STORY}<div class='related'><ul><li><a href='/a'>One more</a></li></ul></div></article>", "words of the story stand here " * 20),
        (f"<div class='c'>{STORY}</div><div class='cookie-notice'><p>We use cookies, as every site does.</p></div>", "words of the story stand here " * 20),
        (f"<aside><p>at the side</p></aside><main>{STORY}<form><p>your name</p></form></main>", "words of the story stand here " * 20),
        (f"<table><tr><td class='nav'>menu</td><td>{STORY}</td></tr></table>", "words of the story stand here " * 20),
        (f"<div style='display: none'>{STORY}</div><p>seen</p>", "seen"),
        ("<p>a &lt;b&gt; &eacute;&#233;&#x1F600; c<br>d<wbr>e</p>", "a <b> éé😀 c de"),
    ],
)
def test_pages_of_many_kinds(body, want):
    assert page_text.read(f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav>{body}<footer>foot</footer></body></html>") == want.strip()


def test_a_path_that_holds_only_a_teaser_is_passed_over(spark):
    long = "<div class='c2'><p>" + "the real text of the page " * 30 + "</p></div>"
    usual = "<body><div class='content'><p>" + "a usual page of the host " * 30 + "</p></div></body>"
    rows = [(i, "http://h.example/x", usual) for i in range(30)] + [(50 + i, "http://h.example/w", f"<body>{long}</body>") for i in range(20)] + [(90, "http://h.example/y", f"<body><div class='content'><p>short teaser</p></div>{long}</body>"), (100, "http://h.example/z", "<body><div class='content'><p>brief</p></div><div class='c3'>and a few more</div></body>")]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "p")).collect()}
    assert got[90].endswith(got[50]) and got[50] == ("the real text of the page " * 30).strip() and got[0] == ("a usual page of the host " * 30).strip() and got[100] == "brief"


@pytest.mark.parametrize("markup", ["<div class='sidebar a'>", "<font>", "<div class='x'><p>", "</i></b></x>", "<ul><li>"])
def test_deep_and_broken_pages_take_time_by_their_length(markup):
    import time

    began = time.perf_counter()
    assert page_text.read("<body>" + markup * 40_000 + "<p>the text</p>") == "the text"
    assert time.perf_counter() - began < 20


def test_pages_of_equal_ids_and_clashing_names(spark, monkeypatch):
    rows = [(1, f"https://h{i % 40}.example/{i}", f"<body><article><p>text {i}</p></article></body>", "host", 1, None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, keys int, pages string")
    want = sorted(f"text {i}" for i in range(200))
    assert sorted(r.text for r in page_text.extract(pages, Scratch(spark, "p")).collect()) == want
    monkeypatch.setattr(page_text, "BROADCAST_ROWS", 3)
    assert sorted(r.text for r in page_text.extract(pages, Scratch(spark, "p")).collect()) == want


def test_templates_of_a_host_win_over_their_common_ancestor(spark):
    story = "<p>" + "words of the story stand here " * 20 + "</p>"
    html = ["<body><div class='teaser'>some more text to read</div><div class='%s'>%s</div></body>" % (c, story) for c in ("article-a", "article-b")]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", html[i % 2]) for i in range(10)], "page_id long, url string, html string")
    assert page_text.consensus(pages).first().paths[:2] == [">body>div.article-a", ">body>div.article-b"]
    assert {r.text for r in page_text.extract(pages, Scratch(spark, "p")).collect()} == {("words of the story stand here " * 20).strip()}


def test_page_text(spark):
    page = '<html><head><title>x</title></head><body class="has-sidebar"><div class="menu"><a href="/">Home</a></div><article id="a%d"><header>skip</header><h1>T &amp; U</h1><p>one <b>two</b>three<p>four&nbsp;five<br>six<!-- no --><script>var x="</p>"</script><form>f</form></article><div class="comments"><p>%s</p></div><footer>end'
    rows = [(i, f"https://www.h.example/{i}", page % (i, "reader words " * 40)) for i in range(5)] + [(9, None, None), (10, "bad url", "<p>only <i>this"), (11, "https://h.example/e", ""), (11, None, "a < b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in page_text.extract(pages, Scratch(spark, "p")).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert all(got[i] == ["T & U one twothree four five six"] for i in range(5))
    assert got[9] == [""] and got[10] == ["only this"] and sorted(got[11]) == ["", "a < b"]
    assert page_text.extract(pages.where("page_id < 0"), Scratch(spark, "p")).collect() == []


# ---- 5: near duplicates
@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, docs, corpus, n, percent):
    rows = near_dedup.near_duplicates(docs, Scratch(spark, "n"), n, percent).collect()
    parts = brute.near([(i, t) for i, t, *_ in corpus], n, percent)
    text = {i: t for i, t, *_ in corpus}
    assert len(rows) == len(corpus) and len(set(parts.values())) < len(corpus) - 10
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(brute.shingle_set(text[i], n)), c, c == i) for i, c in parts.items()}


@pytest.mark.parametrize("tight", [False, True])
def test_parts_of_a_cluster_are_compared(spark, no_docs, tight, monkeypatch):
    if tight:  # every join takes its way for heavy keys, and clusters make many blocks
        for module, name, value in ((near_dedup, "BLOCK_ROWS", 20), (near_dedup, "PAIRS_A_TASK", 5), (near_dedup, "HOT", 50), (near_dedup, "LINKS_A_TASK", 10), (graph, "LINKS_A_TASK", 10)):
            monkeypatch.setattr(module, name, value)
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):  # copies at all distances, many of them linked only through others
        w = list(base)
        for _ in range(rnd.randrange(0, 12)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(60)}"
        rows.append((i, " ".join(w), None, None))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, no_docs.schema), Scratch(spark, "n"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near([(i, t) for i, t, *_ in rows], 3, 85)


def test_estimate_corrects_for_chance():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            both, own = rnd.integers(0, 1 << 63, 900, dtype=np.uint64), rnd.integers(0, 1 << 63, (2, 2000), dtype=np.uint64) << np.uint64(1)
            k = int(900 * (1 - share) / (2 * share))
            sets = [np.unique(np.concatenate((both << np.uint64(1), o[:k]))) for o in own]
            regs = near_dedup.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
            errors.append(near_dedup.estimate(regs[:1], regs[1:], *[np.array([float(len(s))]) for s in sets])[0] - share)
        assert abs(np.mean(errors)) < 0.03


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs, Scratch(spark, "n"), 3, 85).collect()
    assert len(rows) == 8 and all(r.kept for r in rows if r.doc_id is None or r.doc_id == 1)
    assert near_dedup.near_duplicates(no_docs, Scratch(spark, "n")).collect() == []


# ---- 6: neighbours
def test_neighbours_in_small_and_large_shards(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(3000, 24)).astype(np.float32)
    v[7] *= 9  # a long vector must be found by everyone it suits
    rows = [(i, x.tolist(), 1, "a", 2) for i, x in enumerate(v)] + [(i, x, None, None, None) for i, x in [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0]), (5061, [3.0]), (5062, [-1.0]), (None, v[0].tolist()), (5080, [None] * 24), (5100, [])]]
    # columns whose names the operator uses itself
    table = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, width int, shard string, score int"))
    assert table.count() == 3003
    s = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(s, -np.inf)
    for shard_rows in (150, 3000):
        out = hnsw.search(table, "vec_id % 20 = 0", Scratch(spark, "h"), shard_rows=shard_rows).toPandas()
        # vectors of another length are searched among themselves
        assert out[out.query_id == 5060].sort_values("rank")[["vec_id", "score"]].values.tolist() == [[5061, 3.0], [5062, -1.0]]
        out, hits = out[out.query_id < 5000], 0
        for q, g in out.groupby("query_id"):
            g = g.sort_values("rank")
            assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[q, g.vec_id], rtol=0, atol=1e-12) and (np.diff(g.score) <= 0).all()
            hits += len(set(g.vec_id) & set(np.argsort(-s[q])[:20]))
        assert out.query_id.nunique() == 150 and hits / 3000 >= 0.95


@pytest.mark.parametrize("kind", ["normal", "wide", "clusters", "some long", "few directions"])
def test_a_shard_finds_nine_in_ten(kind):
    """Recall against brute force on data that make graphs fail: no structure, many dimensions, islands, lengths, near ties."""
    rnd = np.random.default_rng(9)
    n = 2500 if kind == "wide" else 4000
    v = rnd.normal(size=(n, 192 if kind == "wide" else 48))
    if kind == "clusters":
        v = rnd.normal(size=(150, 48))[rnd.integers(0, 150, n)] + 0.05 * v
    if kind == "some long":
        v[rnd.random(n) < 0.01] *= 30
    if kind == "few directions":
        v = np.abs(v) ** 3
    hashes = kernel.mix(np.arange(n).astype(np.uint64))
    graph = hnsw.Graph(hnsw._widen(v, np.linalg.norm(v, axis=1).max(), False), hashes)
    ef = graph.tuned(hnsw._widen(v[rnd.choice(n, 100, replace=False)], 0, True), 21)
    q = rnd.choice(n, 200, replace=False)
    got, s, hits = graph.search(hnsw._widen(v[q], 0, True), ef, 21), v[q] @ v.T, 0
    for i in range(200):
        hits += len(set(got[i].tolist()) & set(np.argsort(-s[i])[:21].tolist()))
    assert hits / 4200 >= 0.93 and ef <= n


def test_neighbours_where_a_third_of_rows_are_equal(spark):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(3000, 24)).astype(np.float32)
    v[1::3] = 2 * v[1]
    table = hnsw.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"))
    out = hnsw.search(table, "vec_id % 20 = 0", Scratch(spark, "h"), shard_rows=3000).toPandas()
    s, hits = hnsw.products(v.astype(float)[:, None], v.astype(float)[None]), 0
    np.fill_diagonal(s, -np.inf)
    for q, g in out.groupby("query_id"):
        want = np.lexsort((np.arange(3000), -s[q]))[:20].tolist()
        got = g.sort_values("rank").vec_id.tolist()
        assert q % 3 != 1 or got == want == [i for i in range(1, 3000, 3) if i != q][:20]
        hits += len(set(got) & set(want))
    assert len(out) == 3000 and hits / 3000 >= 0.9


def test_rows_of_one_vector_or_one_id_are_listed():
    rnd = np.random.default_rng(8)
    ids, v = rnd.integers(0, 60, 400), rnd.integers(-1, 2, (400, 3)).astype(float)
    v[(v == 0).all(axis=1)] = 1.0
    v[:90], ids[:30] = [-0.0, 1.0, 0.0], 20
    v[:45] = [0.0, 1.0, 0.0]
    distinct, sorted_ids, first = hnsw._distinct(ids, v)
    found = np.tile(np.arange(len(distinct), dtype=np.int32), (400, 1))
    who, vec, score = hnsw._listed(sorted_ids, first, ids, found, hnsw.products(distinct[found], v[:, None]), 20)
    assert len(distinct) == len({tuple(x + 0.0) for x in v})
    for q in range(400):
        want = sorted((-float(x @ v[q]), int(i)) for i, x in zip(ids, v) if i != ids[q])[:20]
        assert list(zip((-score[who == q]).tolist(), vec[who == q].tolist())) == want


def test_neighbours_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = hnsw.search(hnsw.usable(few), "vec_id % 20 = 0", Scratch(spark, "h")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert hnsw.search(hnsw.usable(few.where("vec_id > 99")), "TRUE", Scratch(spark, "h")).collect() == []


# ---- 7: byte-level BPE
@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(texts=st.lists(st.text("ab  \n\t,.'s12é 　中\x1c\x85😀THEthand", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoding_equals_tiktoken(tiktoken_encoding, texts):
    bpe = bpe_prefix.loaded(BPE, public_tokenizers.PATTERN)
    ids, offs = bpe.encode_column(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_appends_and_edits(tiktoken_encoding):
    rnd, bpe = random.Random(4), bpe_prefix.loaded(BPE, public_tokenizers.PATTERN)
    pick = lambda n: "".join(rnd.choice("the and of  \nx1,é") for _ in range(n))
    for _ in range(100):
        text = bpe_prefix.EncodedText(bpe, pick(30))
        text.append(pick(5))
        text.edit(rnd.randrange(len(text.text)), rnd.randrange(4), pick(3))
        assert text.ids == tiktoken_encoding.encode_ordinary(text.text)
        piece = pick(40).replace(" ", "").encode()
        at = rnd.randrange(len(piece))
        new, last = bpe.edit(piece, bpe.table(piece), at, 2 if at + 2 <= len(piece) else 0, b"zq")
        assert last == bpe.table(new)


def test_encode_documents(spark, docs, corpus, odd_docs, no_docs, tiktoken_encoding):
    got = {r.doc_id: r for r in bpe_prefix.encode_documents(docs, BPE, with_ids=True).collect()}
    for i, text, *_ in corpus:
        raw = np.array(tiktoken_encoding.encode_ordinary(text or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, bytes(got[i].ids)) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), raw)
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_prefix.encode_documents(odd_docs, BPE).count() == 8 and bpe_prefix.encode_documents(no_docs, BPE).collect() == []


# ---- 8: transport streams
@given(st.binary(max_size=3000), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_stream_round_trip(raw, times):
    payload = transport_stream.padded(raw * times)
    stream = transport_stream.mux(payload)
    got = transport_stream.demux(stream)
    units = -(-len(payload) // transport_stream.UNIT)
    assert got["payload"] == payload and len(payload) % 576 == 0 and len(stream) % 188 == 0
    assert got["pts"] == [k * 16 * 1080 for k in range(units)] and len(got["access"]) == units


def _plain_demux(stream):
    """The elementary stream of a program, packet by packet, from the layout of the format alone."""
    pid = pmt = None
    counters, pes = {}, []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80  # in step, no error flag
        number, control = (p[1] & 0x1F) << 8 | p[2], p[3] >> 4 & 3
        body, random_access = 4, False
        if control & 2:
            random_access = p[4] > 0 and bool(p[5] & 0x40)
            if p[4] > 0 and p[5] & 0x10:  # a clock reference in the first bytes of the field
                base = int.from_bytes(p[6:11], "big") >> 7
                counters.setdefault("clock", []).append(base)
            body = 5 + p[4]
        if not control & 1:
            continue
        assert counters.get(number) in (None, p[3] - 1 & 15)
        counters[number] = p[3] & 15
        data, starts = p[body:], bool(p[1] & 0x40)
        if number == 0 and starts:
            section = data[1 + data[0] :]
            pmt = (section[10] & 0x1F) << 8 | section[11]
        elif number == pmt and starts:
            section = data[1 + data[0] :]
            skip = (section[10] & 15) << 8 | section[11]
            pid = (section[13 + skip] & 0x1F) << 8 | section[14 + skip]
        elif number == pid:
            if starts:
                pes.append((random_access, bytearray()))
            pes[-1][1].extend(data)
    out, times = b"", []
    for access, unit in pes:
        assert unit[:3] == b"\x00\x00\x01" and access
        size, head = int.from_bytes(unit[4:6], "big"), unit[8]
        t = int.from_bytes(unit[9:14], "big")
        times.append((t >> 33 & 7) << 30 | (t >> 17 & 0x7FFF) << 15 | t >> 1 & 0x7FFF)
        out += bytes(unit[9 + head : 6 + size])
    assert counters["clock"] == times
    return out, times


@given(st.integers(0, 70_000), st.integers(0, 255))
@settings(max_examples=40, deadline=None)
def test_streams_are_read_by_an_independent_reader(n, fill):
    payload = transport_stream.padded(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes() + bytes([fill]) * (n % 7))
    out, times = _plain_demux(transport_stream.mux(payload))
    assert out == payload and times == [k * 16 * 1080 for k in range(len(times))]


def test_long_streams_keep_their_times(spark, no_docs):
    text = "some words, é, and more\n" * 60_000
    row = transport_stream.inspect(transport_stream.store(spark.createDataFrame([(1, text, None, None), (1, text, "x", "y")], no_docs.schema), Scratch(spark, "v"))).collect()
    raw = text.encode()
    assert len(row) == 2 and row[0].media_sha256 == row[1].media_sha256 and row[0].n_bytes == len(raw) and row[0].payload_sha256 == hashlib.sha256(raw + b"\xff" * (-len(raw) % 576)).hexdigest()


def test_lost_packets_and_bad_tables_are_seen():
    stream = bytearray(transport_stream.mux(transport_stream.padded(b"x" * 9000)))
    lost = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    with pytest.raises(ValueError, match="continuity"):
        transport_stream.demux(lost)
    assert transport_stream.demux(lost, strict=False)["gaps"] == 1
    stream[10] ^= 1
    with pytest.raises(ValueError, match="association"):
        transport_stream.demux(bytes(stream))
    with pytest.raises(ValueError):
        transport_stream.demux(b"")


def test_stored_streams(spark, docs, corpus, odd_docs, no_docs):
    stored = transport_stream.store(docs, Scratch(spark, "v"))
    got = {r.doc_id: r for r in transport_stream.inspect(stored).collect()}
    for i, text, *_ in corpus:
        raw = (text or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert transport_stream.inspect(transport_stream.store(odd_docs, Scratch(spark, "v"))).count() == 8
    assert transport_stream.inspect(transport_stream.store(no_docs, Scratch(spark, "v"))).collect() == []


# ---- 9: language
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_against_plain_naive_bayes(spark, docs, corpus):
    """Counts, priors, smoothing and posteriors by dictionaries, over the same hashed n-grams."""
    import math
    from collections import Counter, defaultdict

    seen, n, marks = defaultdict(Counter), Counter(), {}
    for i, text, lang, _ in corpus:
        low = (text or "").lower()
        bins, _ = language_id.features([text or ""])
        # every run of one to three characters, each in the bin of its own
        assert len(bins) == sum(max(0, len(low) - k) for k in range(3))
        marks[i] = bins.tolist()
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and text is not None:
            n[lang] += 1
            seen[lang].update(marks[i])
    want = {}
    for i, text, *_ in corpus:
        if not any(c.isalpha() for c in text or ""):
            want[i] = ("und", 0.0)
            continue
        joint = {x: math.log(n[x] / sum(n.values())) + sum(math.log((seen[x][b] + 0.5) / (sum(seen[x].values()) + 0.5 * 65536)) for b in marks[i]) for x in sorted(n)}
        best = max(joint, key=lambda x: joint[x])
        want[i] = (best, 1 / sum(math.exp(v - joint[best]) for v in joint.values()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)


def test_languages_in_any_number_of_groups(spark, docs, no_docs, monkeypatch):
    """A group of languages at a time comes to what all at once do; and more languages than one group holds."""
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    many = spark.createDataFrame([(i, f"{chr(97 + i % 20)}{chr(97 + i // 20 % 20)}{chr(97 + i % 7)} " * 6, f"l{i % 300:03d}", None) for i in range(900)], no_docs.schema)
    at_once = language_id.LANG_GROUP
    found = {r.doc_id: r.lang_pred for r in language_id.identify(many).collect()}
    assert len(set(found.values())) > at_once and sum(p == f"l{i % 300:03d}" for i, p in found.items()) > 500
    monkeypatch.setattr(language_id, "LANG_GROUP", 1)
    parts = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert {i: p for i, (p, _) in parts.items()} == {i: p for i, (p, _) in whole.items()} and all(parts[i][1] == pytest.approx(whole[i][1], abs=1e-9) for i in whole)


def test_language_ties_long_and_odd_texts(spark, no_docs, monkeypatch):
    monkeypatch.setattr(language_id, "FLUSH", 50)
    rows = [(i, "abc" if i % 2 else "abc", ["x", "a"][i % 2], None) for i in range(40)] + [(100, "a\0b" * 3, None, None), (101, "xyz " * 200_000, "x", None), (102, "1\0 2", None, None), (102, "word", None, None)]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(spark.createDataFrame(rows, no_docs.schema)).collect()}
    assert (102, "und") in got and (101, "x") in got and len({p for i, p in got if i < 40}) == 1
    none = language_id.identify(spark.createDataFrame([(1, "text", None, None)], no_docs.schema)).first()
    assert (none.lang_pred, none.score, none.has_letter) == ("und", 0.0, True)


def test_language_odd_rows(spark, odd_docs, no_docs, docs):
    rows = language_id.identify(odd_docs).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(r.lang_pred for r in rows if r.doc_id in (2, 3)) == ["und", "und"]
    assert language_id.identify(no_docs).collect() == []
    assert {r.doc_id: r.held_out for r in language_id.identify(docs).collect()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.select("doc_id").collect()}


# ---- 10: passages
@pytest.mark.parametrize("small, many_docs", [(False, False), (True, False), (True, True)])
def test_passages_against_brute_force(spark, docs, corpus, small, many_docs, monkeypatch):
    if small:  # many blocks and slices, wide counters
        for name, value in (("BLOCK_BYTES", 2000), ("SLICE_BYTES", 100), ("LEAST_SLICES", 300)):
            monkeypatch.setattr(substring_dedup, name, value)
    if many_docs:  # counters leave no room for the number of a document
        monkeypatch.setattr(substring_dedup.math, "log2", lambda x: 62.0 if x > 10_000 else 9.0)
        monkeypatch.setattr(substring_dedup, "MOST_BITS", 62)
    rows = substring_dedup.remove_repeats(docs, Scratch(spark, "d")).collect()
    want = brute.substring([(i, t) for i, t, *_ in corpus])
    assert len(rows) == len(corpus)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == {i: (len(w), len(w) - len(k), " ".join(k)) for i, (w, k) in want.items()}


def test_windows_of_one_first_hash_are_told_apart(monkeypatch, tmp_path):
    """With a first hash of three bits only, the second one decides: nothing is removed that does not repeat."""
    import pyarrow.parquet as pq

    rnd = random.Random(2)
    texts = [" ".join(f"v{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    texts += [texts[3], " ".join(texts[5].split()[2:20])]
    real = kernel.rolling
    monkeypatch.setattr(kernel, "rolling", lambda *a: (lambda h, at: (h & np.uint64(7 << 61), at))(*real(*a)))
    batch = pa.record_batch([pa.array([1] * 42, pa.int64()), pa.array(range(42), pa.int64()), pa.array(texts)], names=["__block", "doc_id", "text"])
    log_w, bits = 24, 18

    def step(f, key):
        table = pa.Table.from_batches(list(f(iter([batch]))))
        return [(k, table.filter(pa.compute.equal(table["slice"], k))) for k in table["slice"].unique().to_pylist()]

    for name, make, merge in (("hot", substring_dedup._sketch(13, log_w, bits), substring_dedup._merge_sketch), ("told", substring_dedup._ask(f"file://{tmp_path}/hot", 13, log_w, bits), substring_dedup._answer)):
        (tmp_path / name / "block=1").mkdir(parents=True)
        made = pa.concat_tables([merge((pa.scalar(k),), t) for k, t in step(make, name)])
        pq.write_table(made, tmp_path / name / "block=1" / "x.parquet")
    schema = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64())])
    got = pa.Table.from_batches(list(substring_dedup._cut(f"file://{tmp_path}/told", 13, schema)(iter([batch]))))
    assert got["n_removed"].to_pylist() == [0] * 40 + [30, 18]


def test_passages_odd_rows(spark, odd_docs, no_docs):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(2, long, None, None), (None, long, None, None), (2, long, None, None), (1, None, None, None)]
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, no_docs.schema), Scratch(spark, "d")).collect()]
    assert sorted(got, key=str) == sorted([(2, 0), (2, 0), (None, 40), (1, 0)], key=str)
    assert substring_dedup.remove_repeats(odd_docs, Scratch(spark, "d")).count() == 8
    assert substring_dedup.remove_repeats(no_docs, Scratch(spark, "d")).collect() == []


@pytest.mark.parametrize("module", [mixing, substring_dedup])
def test_oracle_sql(spark, docs, module, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = module.query(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(module.ORACLE_SQL).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)))
    assert rows(got) == rows(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=30), st.integers(0, 10_000))
def test_merging_many_strings_is_merging_each(words, seed):
    rng = np.random.default_rng(seed)
    tokens = ["a", "b", "c"]
    while len(tokens) < 40:
        made = "".join(tokens[i] for i in rng.integers(0, len(tokens), 2))
        if made not in tokens:
            tokens.append(made)
    pairs = [(tokens.index(t[:k]), tokens.index(t[k:]), r) for r, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
    left, right, made = np.array(pairs, np.int64).T
    merges = merging.PairMerges(left, right, made, np.arange(len(tokens)))
    ids, per = merges(np.array([tokens.index(c) for w in words for c in w]), np.array([len(w) for w in words]))
    want = []
    for w in words:
        parts = list(w)
        while ranks := [(tokens.index(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]:
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want.append([tokens.index(p) for p in parts])
    assert ids.tolist() == [i for x in want for i in x] and per.tolist() == [len(x) for x in want]


def test_integer_table_against_a_dict():
    rng = np.random.default_rng(5)
    table, held = merging.IntTable(-1), {}
    for _ in range(20):
        keys = np.setdiff1d(rng.integers(0, 5_000, 700), list(held))
        table.add(keys, (keys * 3).astype(np.int32))
        held |= {int(k): int(k) * 3 for k in keys}
        asked = rng.integers(0, 6_000, 2_000)
        assert table.get(asked).tolist() == [held.get(int(k), -1) for k in asked]


def test_matches_around_the_length_of_common_tables():
    bpe = bpe_prefix.PrefixBpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for n in (1, 2, 62, 63, 64, 65, 66, 200):
        for letter in ("x", "ab", "漢", "é", "qz"):
            piece = (letter * n).encode()[:n].decode(errors="ignore") or "x"
            if piece.encode() not in bpe.ranks:
                assert bpe.encode(piece).tolist() == bpe.walk(bpe.table(piece.encode()))


# ---- 11: divergence of sources
def _plain_divergence(rows, min_docs, top):
    """{(lang, source, part, item): (value, rank)} of (text, lang, source) rows, term by term."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER)), g or "", s or "") for t, g, s in rows]
    out = {}
    for lang in {g for _, g, _ in rows}:
        mine = [(w, s) for w, g, s in rows if g == lang]
        docs = Counter(x for w, _ in mine for x in set(w))
        kept = [x for x, n in docs.items() if n >= min_docs]
        count = {s: Counter(x for w, t in mine if t == s or s is None for x in w if docs[x] >= min_docs) for s in {None, *(s for _, s in mine)}}
        share = {s: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept} for s, c in count.items()}
        apart = lambda a, b, x: (share[a][x] - share[b][x]) ** 2 // share[b][x]
        for s in count.keys() - {None}:
            lists = {"pair": {t: sum(apart(s, t, x) for x in kept) for t in count.keys() - {None, s}}, "term": {x: apart(s, None, x) for x in kept if count[s][x] and share[s][x] > share[None][x]}}
            for part, values in lists.items():
                order = sorted(values, key=lambda i: (-values[i], i.encode()))[: top if part == "term" else None]
                out |= {(lang, s, part, i): (values[i], k + 1) for k, i in enumerate(order)}
    return out


def _divergence(df, scratch, **how):
    got = divergence.audit(df, scratch, **how).collect()
    assert len({r[:4] for r in got}) == len(got)
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got}


def test_divergence_against_a_plain_count(spark, docs, corpus, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_SHARDS", 3)
    rows = [(t, g, s) for _, t, g, s in corpus]
    # the corpus has words with digits; letters of their own make terms
    made = [(f"{'É' if i % 2 else 'A'}b c-{'abcdefgh'[i % 8]} {'zz ' * (i % 5)}{'x' * (i % 4)}\0y@Z[q`r{{s", ["en", "fr", None][i % 3], ["s0", "s1", None][i // 3 % 3]) for i in range(60)]
    df = spark.createDataFrame([(*r, 1, 2) for r in made], "text string, lang string, source string, n int, value int")
    for how in ({"min_docs": 3, "top": 200}, {"min_docs": 1, "top": 4}, {"min_docs": 1000, "top": 5}):
        assert _divergence(df, Scratch(spark, "t"), **how) == _plain_divergence(made, **how)
    assert _divergence(docs, Scratch(spark, "t"), min_docs=3, top=200) == _plain_divergence(rows, 3, 200)
    odd = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert _divergence(odd_docs, Scratch(spark, "t"), min_docs=2, top=3) == _plain_divergence(odd, 2, 3)
    assert _divergence(no_docs, Scratch(spark, "t")) == {}


def test_divergence_of_long_texts_and_many_chunks(spark, monkeypatch):
    """Counts are merged over chunks and held rows many times, and squares and sums leave 32 bits far behind."""
    monkeypatch.setattr(divergence, "LEAST_SHARDS", 3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rnd = random.Random(3)
    made = [(" ".join("".join(rnd.choice(letters) for _ in range(rnd.choice([1, 1, 2, 3]))) for _ in range(rnd.choice([3, 40, 9000]))), "en", f"s{min(i % 9, 3)}") for i in range(120)]
    made += [("the " * 200_000, "en", "s0")]
    df = spark.createDataFrame(made, "text string, lang string, source string").repartition(2)
    assert _divergence(df, Scratch(spark, "t")) == _plain_divergence(made, 3, 200)


# ---- 12: lines
def _plain_lines(rows, min_chars, min_docs):
    """[(doc_id, lines, lines dropped, kept text)] of (doc_id, text) rows; rows of one id are one document, those without one by text."""
    name = lambda i, t: (0, t or "") if i is None else (1, i)
    order = lambda d: d if d[0] else (0, _print[d[1]])
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(name(i, t))
    last = {k: max(d, key=order) for k, d in holders.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), name(i, t)) == name(i, t)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


_print = {}


def _lines(df, scratch, **how):
    _print.update({r.text: r.p for r in df.selectExpr("text", "xxhash64(text) AS p").collect()})
    found = line_dedup.dedup_lines(df, scratch, keep=["text"], **how)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.kept_text(found).collect()), key=repr)


def test_lines_against_a_plain_pass(spark, docs, odd_docs, no_docs):
    rnd = random.Random(5)
    shared = [f"Line {k} of the shared kind, long enough to count é" + "!" * (k % 3) for k in range(12)] + ["x" * 39, "y" * 40, "ü" * 40, "ü" * 39, "z" * 70_000, " ", ""]
    spaced = lambda x: rnd.choice(["", " ", "\t\x0b", "\r", " "]) + rnd.choice([x, x.upper(), x.lower()]) + rnd.choice(["", "  ", "\r", "\x0c"])
    text = lambda: "\n".join(spaced(rnd.choice(shared[: rnd.choice([3, 12, 19])])) for _ in range(rnd.choice([1, 2, 9])))
    rows = [(rnd.choice([None, *range(40)]), text()) for _ in range(90)] + [(3, None), (None, None), (5, ""), (6, "\n"), (7, "\n\n" + shared[0] + "\n"), (900, (shared[1] + "\n") * 20_000)]
    rows += [rows[0], rows[0], rows[8]]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, pos int, keep_bits string")
    for how in ({"min_chars": 40, "min_docs": 5}, {"min_chars": 40, "min_docs": 1}, {"min_chars": 1, "min_docs": 2}, {"min_chars": 41, "min_docs": 70}):
        assert _lines(df, Scratch(spark, "t"), **how) == _plain_lines(rows, **how)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _lines(odd_docs, Scratch(spark, "t"), min_chars=5, min_docs=2) == _plain_lines(odd, 5, 2)
    assert _lines(no_docs, Scratch(spark, "t")) == []


def test_bitmaps_are_of_lines(spark):
    line = "a line that stands in every document, again and again"
    df = spark.createDataFrame([(i, f"own {i}\n{line}\n\n{line}\nend", i) for i in range(6)], "doc_id long, text string, extra int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, Scratch(spark, "t"), keep=["extra"]).collect()}
    assert got[0].asDict().keys() == {"doc_id", "extra", "n_lines", "n_dropped", "keep_bits"}
    assert got[5].keep_bits is None and zlib.decompress(got[2].keep_bits) == bytes([0b10101000]) and got[2].n_dropped == 2


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 7), st.integers(0, 1)), max_size=60), st.lists(st.integers(1, 9), min_size=1), st.integers(0, 60), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_ranges_judge_as_one(entries, sizes, cut, min_docs):
    """Two ranges that never part a document of a key, read in batches of any size, come to what one does."""
    entries = sorted({(k, d, p) for k, d, p in entries}, key=lambda e: (e[0], -e[1], e[2]))
    while 0 < cut < len(entries) and entries[cut][:2] == entries[cut - 1][:2]:
        cut += 1
    docs_of = {k: {d for a, d, _ in entries if a == k} for k, _, _ in entries}
    want = {(k, d, p) for k, d, p in entries if len(docs_of[k]) >= min_docs and d < max(docs_of[k])}
    gone, open_, seen = set(), set(), defaultdict(list)
    for part in (entries[:cut], entries[cut:]):
        batches, at = [], 0
        while at < len(part):
            piece = np.array(part[at : at + sizes[len(batches) % len(sizes)]], np.int64)
            at += len(piece)
            k, d, p = piece.T
            batches.append({"h1": k, "h2": k, "doc": d, "own": 0 * d, "print": d, "n_lines": d, "pos": p})
        for kind, n, rows in line_dedup.judged(iter(batches), min_docs):
            told = set(zip(rows["h1"].tolist(), rows["doc"].tolist(), rows["pos"].tolist()))
            if kind == line_dedup.SEEN:
                seen[rows["h1"][0]].append((n, rows["doc"][0]))
            else:
                (gone if kind == line_dedup.GOES else open_).update(told)
    gone |= {(k, d, p) for k, d, p in open_ if sum(n for n, _ in seen[k]) >= min_docs and d < max(x for _, x in seen[k])}
    assert gone == want
    assert all(len(x) <= 2 for x in seen.values())


# ---- 13: hard negatives
def _plain_negatives(rows, is_anchor, positives=5, negatives=3):
    """Sorted results over (vec_id, label, whole numbers) rows, every pair scored."""
    rows, out = list(dict.fromkeys((i, y, tuple(v)) for i, y, v in rows)), []
    for i, y, v in rows:
        if not is_anchor(i):
            continue
        score = [(-sum(int(a) * int(b) for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in score if x[2] == y)[:positives]:
            near = sorted(x for x in score if x[2] != y and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(near)]
    return sorted(out)


def _negatives(spark, rows, is_anchor, **how):
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, y, v in rows], "vec_id long, embedding array<double>, label int, rank int, anchor string")
    got = hard_negatives.mine(hard_negatives.usable(df), is_anchor, Scratch(spark, "t"), **how).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_SHARDS", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2_000)
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(6, 4))
    rows = [(i, int(rng.integers(3)), (heart[i % 6] + 0.3 * rng.normal(size=4)).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 4, heart[0].tolist()) for i in range(150)]  # copies of one vector, under every label
    rows += [(2000 + i, 1, [0.5, -0.25]) for i in range(12)] + [(2020, 2, [0.4, -0.2]), (2030, 2, [0.0, 0.0]), (2040, 9, [1.0]), (2050, 9, []), (2060, 8, [])]
    rows += rows[:3] + [(0, 2, rows[5][2]), (10, rows[10][1], rows[11][2])]  # repeated rows, and other rows of one id
    odd = [(None, 1, rows[0][2]), (3000, None, rows[0][2]), (3010, 1, None), (3020, 1, [1.0, None, 1.0, 1.0]), (3030, 1, [float("nan"), 0.0, 0.0, 0.0]), (3040, 1, [float("inf"), 0.0, 0.0, 0.0])]
    whole = [(i, y, np.floor(256 * np.array(v))) for i, y, v in rows]
    assert _negatives(spark, rows + odd, "vec_id % 10 = 0") == _plain_negatives(whole, lambda i: i % 10 == 0)
    assert _negatives(spark, rows[:60], "vec_id % 2 = 0", positives=2, negatives=1) == _plain_negatives(whole[:60], lambda i: i % 2 == 0, 2, 1)
    assert _negatives(spark, [], "vec_id % 2 = 0") == []


def test_shards_of_long_vectors_are_bounded_by_bytes(spark, monkeypatch):
    """Long vectors make more shards, in each of which every query is answered."""
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 200 * 300 * 8)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1000, 300))
    df = hnsw.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    scratch = Scratch(spark, "t")
    found = {}
    for r in hnsw.search(df, "vec_id % 20 = 0", scratch).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert spark.read.parquet(scratch.path("graphs")).count() == 5
    exact = {q: set(np.argsort(-np.where(np.arange(1000) == q, -np.inf, v @ v[q]))[:20].tolist()) for q in range(0, 1000, 20)}
    assert np.mean([len(found[q] & exact[q]) / 20 for q in exact]) >= 0.95


def test_dual_trees_prune_whole_groups_and_lose_nothing():
    rng = np.random.default_rng(4)
    heart = 400 * rng.normal(size=(20, 8))
    x = np.floor(np.repeat(heart, 200, axis=0) + 20 * rng.normal(size=(4000, 8)))
    label, ids = rng.integers(0, 5, 4000), rng.permutation(4000)
    a = x[::20]
    all_scores = (a @ x.T).astype(np.int64)
    # an anchor's own best, then what is just below it
    for low, high, surely in ((np.full((200, 1), -(1 << 62)), np.full((200, 1), 1 << 62), 3), (all_scores.max(axis=1, keepdims=True) // 2, all_scores.max(axis=1, keepdims=True) * 9 // 10, None)):
        wanted = hard_negatives.Wanted(low, high, 3)
        scored = hard_negatives.dual_search(hard_negatives.Tree(a, 8), a, hard_negatives.Tree(x, 16), x, ids, wanted, lambda r, c: np.ones(len(r), bool), surely)
        assert scored < all_scores.size // 4
        for k in range(200):
            good = [(-s, i) for s, i in zip(all_scores[k].tolist(), ids.tolist()) if low[k, 0] <= s <= high[k, 0]]
            want = sorted(good)[:3]
            got = [(-s, i) for s, i in zip(wanted.score[k, 0].tolist(), wanted.id[k, 0].tolist()) if s > hard_negatives.LOWEST]
            assert got == want


def test_products_are_exact_or_refused():
    big = np.array([[3.0e9, 1.0]])
    assert hard_negatives.products(big, big).tolist() == [[9 * 10**18 + 1]]
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[1e10]]), np.array([[1e10]]))


# ---- 4: what belongs to an article, and what does not
STORY = "<p>" + "words of the story stand here " * 7 + "</p>"


@pytest.mark.parametrize(
    "line,kept",
    [
        ("<div data-id='comments-1'><p>X</p></div>", True),
        ("<div data-role='search'><p>X</p></div>", True),
        ("<p x-class='share'>X</p>", True),
        ("<div data-hidden='false'><p>X</p></div>", True),
        ("<p data-hidden='0'>X</p>", True),
        ("<p>see <a href='/list?class=ads'>X</a> there</p>", True),
        ("<p>see <a href='/list' title='id=menu class=ads'>X</a> there</p>", True),
        ("<div class='share-prices'><p>X rose</p></div>", True),
        ("<section id='comment-on-the-law'><p>X says</p></section>", True),
        ("<div id='cookie-recipes'><p>X grams</p></div>", True),
        ("<p>so <math><mi>X</mi><mo>=</mo><mn>2</mn></math> holds</p>", True),
        ("<aside><p>X in brief</p></aside>", True),
        ("<aside><p><a href='/'>X</a></p></aside>", False),
        ("<aside class='related'><p>X</p></aside>", False),
        ("<aside>X</aside>", False),
        ("<div class='comment-list'><p>X</p></div>", False),
        ("<div id='comments-12'><p>X</p></div>", False),
        ("<div class='share-buttons'><p>X</p></div>", False),
        ("<div class='ad-slot'><p>X</p></div>", False),
        ("<div class=\"cookie-banner\"><p>X</p></div>", False),
        ("<div hidden><p>X</p></div>", False),
        ("<dialog><p>X</p></dialog>", False),
        ("<p>a <math><semantics><mi>b</mi><annotation encoding='TeX'>X</annotation></semantics></math></p>", False),
    ],
)
def test_a_line_of_an_article(line, kept):
    got = page_text.read(f"<html><body><nav>menu</nav><article><h1>Title</h1>{STORY}{line}{STORY}</article><footer>foot</footer></body></html>")
    assert ("X" in got) == kept and got.startswith("Title words") and got.endswith("stand here")


def test_headers_of_articles_and_of_sites():
    read = lambda x: page_text.read(f"<body><header><h1>Site</h1><p>slogan</p></header>{x}<aside><p>side</p></aside></body>")
    assert read(f"<article><header><h1>Title</h1><p>lead</p></header>{STORY}</article>").startswith("Title lead words")
    assert read(f"<article><header><a href='/'>Home</a> <a href='/b'>News</a></header>{STORY}</article>").startswith("words")
    last = read(f"<article>{STORY}<aside><p>about the site</p></aside></article>")
    assert last.endswith("stand here")  # an aside after the last paragraph is no part of the story


def test_generated_pages_give_what_they_were_made_of(spark):
    """Pages put together from parts known to be text or not, of three templates; brute force is what was put in."""
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(["river", "stone", "winter", "a &amp; b", "caf&eacute;", "light", "of", "the"]) for _ in range(n))
    plain = lambda x: " ".join(x.replace("&amp;", "&").replace("&eacute;", "é").split())
    links = lambda: "".join(f"<li><a href='/{i}'>{text(2)}</a></li>" for i in range(rnd.randrange(3, 7)))
    junk = [lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<div class='ad-{rnd.randrange(9)}'>{text(6)}</div>", lambda: f"<form><input value='x'>{text(3)}</form>", lambda: f"<script>var a = '<p>{text(3)}</p>'</script>", lambda: f"<div class='sidebar'><p>{text(30)}</p></div>", lambda: f"<div id='comments'><p>{text(40)}</p></div>", lambda: f"<!-- {text(3)} -->", lambda: f"<div role='dialog'>{text(8)}</div>", lambda: f"<footer>{text(5)}</footer>"]
    rows, want = [], {}
    for page in range(60):
        parts, story = [], []
        for _ in range(rnd.randrange(2, 8)):
            words = text(rnd.randrange(12, 60))
            tag = rnd.choice(["p", "p", "p", "h2", "blockquote", "li"])
            parts.append(f"<{tag}>{words}</{tag}>")
            story.append(words)
            if rnd.random() < 0.4:
                parts.append(rnd.choice(junk[1:4] + junk[6:7])())
        open_, shut = [("<article>", "</article>"), ("<main><div class='content'>", "</div></main>"), ("<div id='post-%d' class='entry'>" % page, "</div>")][page % 3]
        around = [rnd.choice(junk)() for _ in range(6)]
        rows.append((page, f"http://h{page % 3}.example/{page}", f"<html><head><title>{text(3)}</title></head><body>{''.join(around[:3])}{open_}{''.join(parts)}{shut}{''.join(around[3:])}</body></html>"))
        want[page] = plain(" ".join(story))
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "p")).collect()}
    assert {k for k in want if got[k] != want[k]} == set()


def test_copies_and_wordless_documents_are_spread(spark, monkeypatch):
    """The last step deals neither the copies of one text nor documents without words to one task, and changes nothing."""
    rows = [(i, "a text of some words that is copied very often") for i in range(300)] + [(1000 + i, "  ") for i in range(200)] + [(2000 + i, f"text number {i} of its own kind and more") for i in range(60)] + [(None, "a text of some words that is copied very often")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, Scratch(spark, "t")).collect()), key=repr)
    assert len(got) == len(rows) and all(kept == (c is None or i == c) for i, c, kept in got)
    assert {c for i, c, _ in got if i is not None and i < 300} == {0} and all(i == c for i, c, _ in got if i is None or i >= 1000)


def test_files_and_patterns_of_other_forms(spark, docs, tmp_path):
    data = json.load(open(WORD_BPE, encoding="utf-8"))
    data["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(data), encoding="utf-8")
    with pytest.raises(ValueError):
        token_shards.write_shards(docs, Scratch(spark, "t"), str(other))
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(BPE, "rb"))}
    pattern = r"\s*\S\S|\s*\S|\s+"
    plain = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_prefix.encode_documents(docs, BPE, pattern, with_ids=True).collect()}
    assert got == {r.doc_id: plain.encode_ordinary(r.text or "") for r in docs.collect()}
