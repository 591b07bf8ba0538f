"""Question sets of several forms in one: source, id, prompt, labels, gold, meta; and a passage corpus of several kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions.spans import truncate_words
from counterlens.operators.evidence import squeezed

COLUMNS = ("source", "id", "prompt", "labels", "gold", "meta")


def _uniform(df: DataFrame, source: str, key: Column, prompt: Column, labels: Column, gold: Column, meta: dict[str, Column]) -> DataFrame:
    kept = F.map_from_arrays(F.array(*map(F.lit, meta)), F.array(*[v.cast("string") for v in meta.values()])) if meta else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.select(F.lit(source).alias("source"), F.concat(F.lit(f"{source}::"), key.cast("string")).alias("id"), prompt.alias("prompt"), labels.alias("labels"), gold.alias("gold"), kept.alias("meta"))


def _letters(n: int) -> list[str]:
    return [chr(ord("A") + i) for i in range(n)]


def by_columns(df: DataFrame, source: str, key: str, question: str, options: Sequence[str], right: str, instruction: str, meta: dict[str, Column] | None = None) -> DataFrame:
    """Options in columns, the right one by its place (from 0). ``instruction`` is a text with {question} and {options}."""
    letters = _letters(len(options))
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{x}. "), F.col(o)) for x, o in zip(letters, options)])
    prompt = F.replace(F.replace(F.lit(instruction), F.lit("{options}"), lines), F.lit("{question}"), F.trim(question))
    return _uniform(df, source, F.col(key), prompt, F.array(*map(F.lit, letters)), F.get(F.array(*map(F.lit, letters)), F.col(right).cast("int")), meta or {})


def by_map(df: DataFrame, source: str, key: str, question: str, options: str, answer: str, instruction: str, letters: Sequence[str] = "ABCD", most_words: int = 350, meta: dict[str, Column] | None = None) -> DataFrame:
    """Options in a map by letter, of which some may lack, the right one by its letter; long questions are cut to ``most_words``."""
    line = lambda x: F.when(F.map_contains_key(options, F.lit(x)), F.concat(F.lit(f"{x}. "), F.coalesce(F.try_element_at(options, F.lit(x)), F.lit(""))))
    lines = F.concat_ws("\n", *[line(x) for x in letters])
    prompt = F.replace(F.replace(F.lit(instruction), F.lit("{options}"), lines), F.lit("{question}"), truncate_words(F.trim(question), most_words))
    return _uniform(df, source, F.col(key), prompt, F.array(*map(F.lit, letters)), F.col(answer), meta or {})


def by_context(df: DataFrame, source: str, key: str, question: str, contexts: str, decision: str, instruction: str, labels: Sequence[str] = ("yes", "no", "maybe"), most_words: int = 400) -> DataFrame:
    """A question on an array of contexts, cut to ``most_words`` together, decided by a word."""
    context = truncate_words(F.array_join(contexts, " "), most_words)
    prompt = F.replace(F.replace(F.lit(instruction), F.lit("{context}"), context), F.lit("{question}"), F.trim(question))
    return _uniform(df, source, F.col(key), prompt, F.array(*map(F.lit, labels)), F.lower(F.trim(decision)), {})


def passages(guidelines: DataFrame, distractors: DataFrame, labels: DataFrame, least: int = 80, most: int = 1200) -> DataFrame:
    """id and text of a retrieval corpus, from (id, text) rows of three kinds, which the ids tell.

    Texts of labels have their white space squeezed; those that are then shorter than
    ``least`` characters are left out, longer ones than ``most`` are cut.
    """
    named = lambda df, kind: df.select(F.concat(F.lit(f"{kind}::"), F.col("id").cast("string")).alias("id"), "text")
    squeezed_ = named(labels, "label").withColumn("text", squeezed(F.col("text"))).where(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))
    return named(guidelines, "guideline").unionByName(named(distractors, "distractor")).unionByName(squeezed_)
