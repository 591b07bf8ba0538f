"""From raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and reread as the next one's docs. All but the last return the columns of documents;
further columns are carried along untouched, whatever their names. What each decides:

- language: documents without a letter (language ``und``) go; a missing label is filled
  with the prediction;
- near duplicates: of each group of near copies the smallest id stays, and of rows that
  share it the first; a row without an id is kept;
- passages: words of passages that start in a document with a smaller id go from the
  text; a document that keeps all its words keeps its text as it is;
- mix: each document is repeated as often as its source's target takes it, in training
  order; a copy that is taken in part keeps its first words;
- tokens: every row's text is encoded.

An empty table stays empty in every stage. The tables that a stage wrote for itself go when
the next stage of the same thread begins, so write a stage's result before that.
"""

from __future__ import annotations

from threading import get_ident

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.llm import bpe_prefix, language_id, mixing, near_dedup, substring_dedup
from counterlens.llm.shared import Scratch, carry

_held: dict[tuple[str, int], Scratch] = {}


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Scratch of a stage. The one before it in this thread has been stored by now, so its tables go."""
    key = (spark.sparkContext.applicationId, get_ident())
    if key in _held:
        _held.pop(key).drop()
    _held[key] = Scratch(spark, name)
    return _held[key]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; where lang is NULL, the language that the classifier reads in the text.

    The classifier learns from the rows that have a label. A table without labels is read
    by no classifier: its rows are kept if they have a letter, and stay without a label.
    NULL and empty texts have no letter. Labels that are there are never changed.
    """
    _scratch(spark, "language")
    named, others, restore = carry(docs, ["doc_id", "text", "lang"])
    found = language_id.identify(named.withColumn("__lang", F.col("lang")), keep=["text", "__lang", *others]).where("has_letter")
    read = F.when(F.col("lang_pred") != language_id.UNKNOWN, F.col("lang_pred"))
    return restore(found.withColumn("lang", F.coalesce("__lang", read)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8): the smallest id.

    Rows are judged one by one: of rows with one id and near texts the first stays, rows
    with one id and different texts all stay. A row without an id is kept. Texts without
    words, and NULL ones, are near to nothing.
    """
    scratch = _scratch(spark, "near")
    named, _, restore = carry(docs, ["doc_id", "text"])
    # rows in the order of their ids; a row's number stands for its id, so rows that share one are judged apart
    placed = named.withColumns({"__id": F.col("doc_id").cast("long"), "__row": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange("__id", "__row").sortWithinPartitions("__id", "__row")
    number = F.when(F.col("__id").isNotNull(), F.monotonically_increasing_id())
    keyed = scratch.table(placed.withColumn("__key", number).drop("__id", "__row"), "keyed")
    judged = near_dedup.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), scratch)
    return restore(keyed.join(judged.where("NOT kept").select(F.col("doc_id").alias("__key")), "__key", "left_anti"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of windows of 13 that also start in a document with a smaller id.

    What is left of a text that loses words is joined by single spaces, and n_chars follows
    it; other texts stay as they are, NULL ones too. Rows that share an id are one document
    and take nothing from each other; a row without an id comes after all others.
    """
    named, others, restore = carry(docs, ["doc_id", "text"])
    original = named.withColumn("__original", F.col("text"))
    cut = substring_dedup.remove_repeats(original, _scratch(spark, "passages"), keep=[*others, "__original"])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("__original"))
    return _counted(restore(cut.withColumn("text", text)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order, so that sources have their target share of words.

    Rows are mixed one by one, whether they share an id or have none; a NULL source is a
    source of its own. A text without words is not taken. A copy taken in part keeps its
    first words, with the white space before them. Equal positions go by id.
    """
    scratch = _scratch(spark, "mix")
    named, _, restore = carry(docs, ["doc_id", "text", "source"])
    keyed = scratch.table(named.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    planned = mixing.plan(keyed, scratch, keep=["__row"])
    copies = mixing.training_copies(planned, keep=["__row"]).drop("doc_id")
    taken = keyed.join(copies, "__row")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("take").cast("int")), "")
    taken = taken.withColumn("text", F.when(F.col("take") < F.col("size"), first).otherwise(F.col("text")))
    ordered = taken.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return _counted(restore(ordered), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every row's whole text; a NULL text has no ids."""
    _scratch(spark, "tokens")
    return bpe_prefix.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mix", mix),
    ("tokens", tokens),
]

#: Sketches, hashes and byte-level merges are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next begins."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = stored.table(stage(spark, docs, sf_dir), name)
        if k:
            stored.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
