"""Sections, sentences and evidence in labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What ends a section, a sentence, and where sentences part.
NEXT_HEADER = r"(?s)\n\s*[A-Z][A-Za-z /&#-]{2,60}:\s*\n.*$"
SENTENCE_END = r"(?s)^(.*[.!?])(?=\s)"
SENTENCE_GAP = r"(?<=[.;])\s+(?=[A-Z(])"
QUALIFIERS = r"(?i)\((?:disorder|finding|procedure|observable entity|substance|product|qualifier value)\)"
STATUS_RANK = {"attested_exact": 0, "attested_qualitative": 1, "construct_mismatch": 2, "absent": 3}


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def section(text: Column, header: str, most: int, least: int = 200) -> tuple[Column, Column]:
    """What follows the first match of ``header`` up to the next header, and why there is nothing.

    Blanks are squeezed; fewer than ``least`` characters are too few; a longer section than
    ``most`` ends with the last sentence that ends inside.
    """
    has = text.rlike(header)
    after = F.regexp_extract(text, f"(?s){header}(.*)$", 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(after, NEXT_HEADER, ""), r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")
    cut = F.substring(body, 1, most)
    whole = F.nullif(F.regexp_extract(cut, SENTENCE_END, 1), F.lit(""))
    reason = F.when(~has, "no section").when(F.length(body) < least, "too short")
    return F.when(reason.isNull() & has, F.when(F.length(body) > most, F.coalesce(whole, cut)).otherwise(body)), reason


def sentences(df: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Non-empty sentences with their place (from 0) and has_number; only the first ``most`` of a text if asked."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_GAP), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    parts = F.slice(parts, 1, most) if most else parts
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("place", "sentence")).withColumn("has_number", F.col("sentence").rlike(r"\d"))


def evidence(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """Of each spec the first section, in its order of preference, that its pattern finds: value, section, context.

    ``labels`` has drug, section, seq, text, the parts of a section in the order of seq; ``specs`` (a small table) family, drug, pattern,
    sections (array; empty means any, in name order) and further columns, which are kept.
    value is the first group. Specs without a match, or without a label, are kept with NULLs;
    ``labelled`` says whether the drug has a label.
    """
    hits = labels.join(specs, "drug").withColumn("_order", F.when(F.size("sections") == 0, 1).otherwise(F.array_position("sections", F.col("section"))))
    hits = hits.where((F.col("_order") > 0) & F.expr("text RLIKE pattern"))
    start = F.expr("regexp_instr(text, pattern)")
    long = F.length(F.expr("regexp_extract(text, pattern, 0)"))
    begin = F.greatest(F.lit(1), start - 120)
    found = F.struct("_order", "section", "seq", F.expr("regexp_extract(text, pattern, 1)").alias("value"), squeezed(F.col("text").substr(begin, start + long + 120 - begin)).alias("context"))
    best = hits.groupBy("family").agg(F.min(found).alias("f")).select("family", "f.value", "f.section", "f.context")
    known = labels.select("drug").distinct().withColumn("_known", F.lit(True))
    return specs.join(known, "drug", "left").join(best, "family", "left").withColumn("labelled", F.coalesce("_known", F.lit(False))).drop("_known")


def attestation(found: DataFrame) -> DataFrame:
    """``evidence`` with status. Uses kind (numeric or qualitative), rules_value and known_trap of the specs."""
    status = (
        F.when(~F.col("labelled"), "no_label")
        .when(F.col("section").isNull(), F.when(F.col("known_trap"), "construct_mismatch").otherwise("absent"))
        .when(F.col("kind") == "qualitative", "attested_qualitative")
        .when(F.col("value").try_cast("double") == F.col("rules_value"), "attested_exact")
        .otherwise("attested_different_value")
    )
    return found.withColumn("status", status)


def fill_worksheet(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Worksheet rows (row, drug, section, sentence) with the first attested family whose context and sentence contain each other's opening.

    ``found`` has order besides what ``attestation`` made, and is small.
    """
    attested = found.where(F.col("status").startswith("attested")).select("order", "family", "status", "value", "drug", F.col("section").alias("_section"), "context")
    touch = F.contains(F.col("context"), F.substring("sentence", 1, 60)) | F.contains(F.col("sentence"), F.substring("context", 1, 60))
    joined = rows.join(attested, "drug").where((F.col("section") == F.col("_section")) & touch)
    first = joined.groupBy("row").agg(F.min(F.struct("order", "family", "status", "value")).alias("f"))
    return rows.join(first.select("row", "f.family", "f.status", "f.value"), "row", "left")


def provenance_rollup(families: DataFrame, attested: Column) -> DataFrame:
    """families ordered by the rank of their status, then name, with the count attested and the total on each row (a small table)."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p]), F.col("status")), F.lit(9))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(rank, "family"))
    return families.withColumns({"n_attested": F.count_if(attested).over(every), "n_families": F.count("*").over(every), "place": place})


def grounding(atoms: Column, full: Column, bare: Column) -> Column:
    """How far a concept's matches rest on its ontology atoms."""
    return F.when(atoms == 0, "lexical").when(full == 0, "unmeasurable").when(bare == 0, "anchored only").when(bare < full / 2, "mostly curated").otherwise("matched")


def norm_atom(text: Column) -> Column:
    """A surface form without qualifiers and bracketed parts, lower-cased, white space squeezed."""
    return squeezed(F.lower(F.regexp_replace(F.regexp_replace(text, QUALIFIERS, " "), r"\[[^\]]*\]", " ")))


def justification(raw: Column, least: int = 4) -> Column:
    """What follows the decision word of an answer, if it has ``least`` words."""
    body = F.regexp_replace(F.regexp_replace(squeezed(raw), r"(?i)^(UNSAFE|NOT SAFE|CONTRAINDICATED|SAFE)", ""), r"^[ .:\-\n\t]+", "")
    return F.when(F.size(F.split(squeezed(body), " ")) >= least, body)
