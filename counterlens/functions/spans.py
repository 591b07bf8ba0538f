"""Spans and rewrites that need Python: mentions, unique locations, rendering."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterlens.functions import statements

# types as objects: workers import this module without a session to parse text
_SPAN = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())
MENTIONS = T.StructType().add("value", T.DoubleType()).add("unit", T.StringType()).add("start", T.IntegerType()).add("stop", T.IntegerType()).add("num_start", T.IntegerType()).add("num_stop", T.IntegerType()).add("mgdl", T.DoubleType())

#: Units of creatinine that are known, by what one mg/dL is of them; another unit, or none, is never guessed at.
MASS, MOLAR = "mg/dl", "umol/l|\u00b5mol/l|\u03bcmol/l|micromol/l"
_NAMES = "serum creatinine|creatinine|creatine"
CREATININE = [statements.stated(_NAMES, f"{MASS}|{MOLAR}", needs_unit=True, exact="Cr"), statements.turned(_NAMES, f"{MASS}|{MOLAR}")]
_MENTION = [re.compile(p) for p in CREATININE]
UNIT_TEXT = r"(?i)(?:mg|[u\u00b5\u03bc]mol|micromol)\s*/\s*d?l"
_UNIT = re.compile(UNIT_TEXT)


def mentions(note: str | None) -> list[tuple]:
    """Creatinine mentions of a note with a known unit: (value, unit, span, span of the number, mg/dL), in order, none inside a longer one.

    A number between two names is a mention of each.
    """
    out: list[tuple] = []
    found = [(m.span(), m) for p in _MENTION for m in p.finditer(note or "")]
    for (start, stop), m in sorted(found, key=lambda x: (x[0][0], -x[0][1])):
        if out and stop <= max(o[3] for o in out):
            continue
        value, unit = float(m[1]), _UNIT.search(note, m.end(1))[0]
        out.append((value, unit, start, stop, *m.span(1), value if "mol" not in unit.lower() else value / 88.4))
    return out


def creatinines(note: Column) -> Column:
    """All creatinine mentions of a note: an array of value, unit and mgdl."""
    text = F.coalesce(note, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CREATININE])
    value = lambda m: F.regexp_extract(m, r"\d+(?:\.\d+)?", 0).cast("double")
    unit = lambda m: F.regexp_extract(m, UNIT_TEXT, 0)
    return F.transform(found, lambda m: F.struct(value(m).alias("value"), unit(m).alias("unit"), F.when(F.lower(unit(m)).contains("mol"), value(m) / 88.4).otherwise(value(m)).alias("mgdl")))


def creatinine(note: Column) -> Column:
    """The creatinine that a note states, as value, unit and mg/dL: NULL unless all its mentions agree."""
    read = creatinines(note)
    settled = F.size(F.array_distinct(F.transform(read, lambda r: F.round(r["mgdl"], 6)))) == 1
    return F.struct(*[F.when(settled, F.get(read, F.lit(0))[n]).alias(n) for n in ("value", "unit", "mgdl")])


@F.udtf(returnType=MENTIONS)
class CreatinineMentions:
    """Table function over one note."""

    def eval(self, note: str):
        yield from mentions(note)


def number_forms(value: float) -> list[str]:
    """The ways in which a number is written: as it is, without trailing zeros, and with one to three decimals."""
    forms = {str(value), f"{value:g}", *(f"{value:.{d}f}" for d in (1, 2, 3))}
    return sorted(forms | ({str(int(value))} if value == int(value) else set()))


def places(text: str, value: float) -> set[tuple[int, int]]:
    """Spans at which a number stands in any written form, not inside a longer number. Forms of one start are apart."""
    forms = number_forms(value)
    starts = (m.start() for m in re.finditer(r"(?<![\d.])(?=[\d.-])", text))
    return {(a, a + len(f)) for a in starts for f in forms if text.startswith(f, a) and not text[a + len(f) : a + len(f) + 1].isdigit()}


@F.pandas_udf(_SPAN)
def locate_unique(note: pd.Series, value: pd.Series) -> pd.DataFrame:
    """Span of the one place where the number stands; NULL if none or several."""
    found = [places(t, v) if t and v is not None and v == v else set() for t, v in zip(note, value)]
    return pd.DataFrame([min(s) if len(s) == 1 else (None, None) for s in found], columns=["start", "stop"]).astype("Int32")


def rewrite_spans(note: Column, where: Column, texts: Column) -> Column:
    """The note with its spans (structs of start and stop, from 0, not crossing) replaced by texts, from the back."""
    edits = F.array_sort(F.arrays_zip(where.alias("w"), texts.alias("t")), lambda a, b: b["w"]["start"] - a["w"]["start"])
    put = lambda text, e: F.overlay(text, e["t"], e["w"]["start"] + 1, e["w"]["stop"] - e["w"]["start"])
    return F.aggregate(edits, note, put)


def redact_first(prompt: Column, patterns: Sequence[str], hidden: str = "[not recorded]") -> Column:
    """The prompt with the number of the first pattern that matches, and of its first match only, hidden; NULL where none matches.

    A pattern's first group is what stays before the number; the rest of the match goes.
    """
    out = []
    for pattern in patterns:
        found, head = F.regexp_extract(prompt, pattern, 0), F.regexp_extract(prompt, pattern, 1)
        out.append(F.when(prompt.rlike(pattern), F.overlay(prompt, F.concat(head, F.lit(hidden)), F.regexp_instr(prompt, F.lit(pattern)), F.length(found))))
    return F.coalesce(*out)


def swap_once(text: Column, old: str, new: str) -> Column:
    """The text with ``old`` replaced by ``new``; an error where it does not stand there exactly once. NULL stays NULL."""
    times = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)
    return F.when(text.isNull() | (times == 1), F.replace(text, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit(f"not exactly one {old!r} in: "), text)))


def truncate_words(text: Column, most: int) -> Column:
    """The first ``most`` words, by single spaces, and a mark that more followed; a text with no more words as it is."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(" ...")))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_literal_map(text: pd.Series) -> pd.Series:
    """Python-literal dictionaries as maps of text."""
    return pd.Series([{str(k): str(v) for k, v in ast.literal_eval(t).items()} if t else None for t in text])


@F.pandas_udf(T.DoubleType())
def compat_round(x: pd.Series, places: pd.Series) -> pd.Series:
    """Rounds half to even on the binary value, as printed precision in Python does."""
    return pd.Series([None if v != v else round(v, int(p)) for v, p in zip(x, places)])
