import hashlib
import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers

import corpus_pipeline
from counterlens.llm import mixing
from counterlens.llm.shared import Scratch
from test_operators import tiktoken_encoding  # noqa: F401


def test_pipeline_against_brute_force(spark, docs, corpus, tmp_path, tiktoken_encoding):  # noqa: F811
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    rows = [(i, t, s) for i, t, _, s in corpus if t and re.search(r"[^\W\d_]", t)]
    parts = brute.near([(i, t) for i, t, _ in rows], 5, 80)
    rows = [r for r in rows if parts[r[0]] == r[0]]
    cut = brute.substring([(i, t) for i, t, _ in rows])
    rows = [(i, t if len(cut[i][0]) == len(cut[i][1]) else " ".join(cut[i][1]), s) for i, t, s in rows]
    text, want = {i: t for i, t, _ in rows}, []
    for i, take, size in brute.mix(rows)[0]:
        part = text[i] if take == size else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text[i])[:take])
        ids = np.array(tiktoken_encoding.encode_ordinary(part), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest()))
    assert got == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, odd_docs, no_docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "mix", "tokens"]
    for start in (odd_docs, no_docs):
        df = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{start.count()}-{k}")
            stage(spark, df, "").write.parquet(out)
            df = spark.read.parquet(out)
            assert name == "tokens" or df.columns == start.columns


def test_rows_that_share_an_id_or_have_none_are_mixed_once_each(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    copies = mixing.training_copies(mixing.plan(docs, Scratch(spark, "m"))).collect()
    got = corpus_pipeline.mix(spark, docs, "").collect()
    count = lambda rows: Counter((r[0], r[1]) for r in rows)
    assert len(got) == len(copies) and any(r.doc_id is None for r in got)
    assert count((r.doc_id, r.take) for r in copies) == count((r.doc_id, len(r.text.split())) for r in got)


def test_one_of_several_equal_rows_stays(spark, odd_docs):
    got = Counter((r.doc_id, (r.text or "")[:5]) for r in corpus_pipeline.near_duplicates(spark, odd_docs, "").collect())
    assert got == {(1, "alpha"): 1, (1, "other"): 1, (None, "alpha"): 1, (None, ""): 1, (2, ""): 1, (3, ""): 1, (4, "xxxxx"): 1}


def test_a_corpus_without_labels_is_kept(spark, no_docs):
    rows = [(1, "some words", None, "s"), (None, "more words", None, None), (2, "123", None, "s"), (2, None, None, "s"), (3, "", None, "s")]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, no_docs.schema), "").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == {(1, "some words", None): 1, (None, "more words", None): 1}


def test_missing_labels_are_read_and_others_left(spark, no_docs):
    rows = [(i, f"the words of {i} are english", "en", None) for i in range(30)] + [(100 + i, f"žluťoučký kůň číslo {i}", "cs", None) for i in range(30)]
    rows += [(900, "the english words are here", None, None), (901, "kůň žluťoučký", None, None), (902, "the words are english", "cs", None)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, no_docs.schema), "").collect()}
    assert (got[900], got[901], got[902], len(got)) == ("en", "cs", "cs", 63)


def test_rows_with_one_id_are_kept_by_their_texts(spark, no_docs):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a, None, None), (2, a, None, None), (2, b, None, None), (None, a, None, None), (None, a, None, None)]
    got = Counter((r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, no_docs.schema), "").collect())
    assert got == {(1, "a"): 1, (2, "b"): 1, (None, "a"): 2}


def test_no_copy_of_a_mix_is_longer_than_its_text(spark, odd_docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken = Counter(), Counter()
    for r in odd_docs.collect():
        size[r.doc_id] += words(r.text)
    for r in corpus_pipeline.mix(spark, odd_docs, "").collect():
        taken[r.doc_id] += words(r.text)
    assert all(taken[i] <= 2 * size[i] for i in taken) and sum(taken.values()) <= 1.5 * sum(size.values()) + 1


def test_public_vocabulary_is_not_in_the_repository():
    assert "/site-packages/" in public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
