r"""How clinical text states quantities and findings, as a small grammar that writes patterns.

A statement is a name, a link of a few words without digits, a number and a unit. The link
ends with the clause, so a number of the next sentence is never taken. A finding is graded
by words that stand before or after it, and denied by a word of denial. Patterns are read
alike by this language's regular expressions and the engine's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

NUMBER = r"(?<![\d.])(\d+(?:\.\d+)?)"


def any_of(words: str | Iterable[str]) -> str:
    """Any of some wordings (separated by | if a text), longest first; a blank stands for any white space."""
    words = words.split("|") if isinstance(words, str) else list(words)
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + ")"


def link(most: int) -> str:
    """Up to ``most`` words without digits, and the marks between them."""
    return rf"(?:[\s:=,(/-]+[A-Za-z]+){{0,{most}}}[\s:=,(~-]*"


def _units(units: str) -> str:
    return r"\s*(?:" + "|".join(r"\s*/\s*".join(re.escape(p) for p in u.split("/")) for u in sorted(units.split("|"), key=len, reverse=True)) + r")(?![A-Za-z])"


def stated(names: str, units: str = "", words: int = 4, needs_unit: bool = False, exact: str = "") -> str:
    """name, link, number (group 1), unit. ``exact`` are names that count only as they are written."""
    name = rf"(?i:\b{any_of(names)})" + (rf"|\b{any_of(exact)}" if exact else "")
    unit = ("(?i:" + _units(units) + ")" + ("" if needs_unit else "?")) if units else ""
    return rf"(?:{name})\b{link(words)}{NUMBER}(?![\d.]*\d){unit}"


def turned(names: str, units: str, words: int = 2) -> str:
    """number (group 1), unit, link, name."""
    return rf"{NUMBER}(?i:{_units(units)}){link(words)}\s*(?i:{any_of(names)})\b"


def bare(units: str, digits: str = r"\d{2,3}") -> str:
    """A number (group 1) of so many digits with a unit that settles what it is."""
    return rf"(?<![\d.])({digits}(?:\.\d+)?)(?i:{_units(units)})"


DENIAL = "no|not|without|denies|never|negative for|free of"


def denied(finding: str, words: int = 3) -> str:
    """A word of denial before the finding, or that it is absent after it."""
    return rf"(?i)\b{any_of(DENIAL)}(?:\W+[a-z]+){{0,{words}}}?\W+{any_of(finding)}\b|\b{any_of(finding)}\b[\s:]*(?:is|was|are)?\s*{any_of('absent|none|negative|resolved|not present')}"


def graded_finding(finding: str, words: Sequence[str], apart: int = 3) -> str:
    """A grading word up to ``apart`` words before the finding, or right after it."""
    grade = any_of(words)
    return rf"(?i)\b{grade}\b(?:\W+[a-z]+){{0,{apart}}}?\W+{any_of(finding)}\b|\b{any_of(finding)}\b[\s:,(-]*(?:is|was)?\s*{grade}\b"
