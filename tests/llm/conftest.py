import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" + rnd.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, short, empty and odd texts."""
    rnd = random.Random(7)
    base = [words(rnd, rnd.randrange(20, 90)) for _ in range(40)]
    rows = list(base)
    rows += [base[3]] * 6 + [base[5]] * 3
    for k in range(12):
        w = base[k % 4].split()
        for _ in range(1 + k // 4):
            w[rnd.randrange(len(w))] = f"new{k}"
        rows.append(" ".join(w))
    passage = words(rnd, 30)
    rows += [words(rnd, 8) + " " + passage + " " + words(rnd, 9) for _ in range(6)]
    rows += ["", "one", "One two", "one two", "a b c", "12 345 !!", "  ", None, "tab\tand\nlines   x 　y", "l'été déjà ïçi Straße", words(rnd, 3000)]
    return [(i * 3 + 1, t, ["en", "fr", None][i % 3], ["s0", "s0", "s0", "s1", "s2", "é", None][i % 7]) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The corpus as a stored table, with columns whose names operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(*r, len(r[1] or ""), 5, "x", None) for r in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double").repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column and repeated rows, from memory."""
    rows = [(1, "alpha beta gamma delta", "en", "s"), (1, "alpha beta gamma delta", "en", "s"), (1, "other words stand here", None, None), (None, "alpha beta gamma delta", "en", "s"), (None, None, None, None), (2, None, "fr", None), (3, "", None, "s"), (4, "x" * 30000, "en", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
