"""Row predicates used by the cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide which texts are dropped.
STREET_WORDS = (
    "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq"
    "|Trail|Trl|Circle|Cir"
)
MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\d{3}[-\.\s]??\d{3}[-\.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-\.\s]??\d{4})\b"
LIST_MARK = r"\.\s?[0-9\-–*]"
LINK = "www|http"
STORY_PROMPTS = [
    "Most people start the day by",
    "Today I am feeling",
    "The thing I like most in the world is",
    "When I was a little kid",
    "I had a terrifying dream last night in which",
    "I worry a lot about",
]
# Number, then one to four words, then a street word. Word runs are separated by at least one
# blank, so each text is scanned in linear time even when a "word" has thousands of characters.
ADDRESS = (
    r"\b\d{1,6}\s+\w+(?:\s+\w+){0,3}\s*(?:" + STREET_WORDS + r")(?:\s+\w+)?(?:,\s+\w+)?"
    r"(?:,\s+\d{5}(?:-\d{4})?)?\b"
)


def has_phone(text: Column) -> Column:
    return text.rlike("(?U)" + PHONE)


def has_address(text: Column) -> Column:
    return text.rlike("(?iU)" + ADDRESS)


def has_mail(text: Column) -> Column:
    return text.rlike("(?iU)" + MAIL)


def looks_like_list(text: Column) -> Column:
    return text.rlike("(?U)" + LIST_MARK)


def has_link(text: Column) -> Column:
    return text.rlike(LINK)


def in_window(n: Column, low: int | None, high: int | None) -> Column:
    """low < n < high, both strict; None leaves a side open."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (n > low)
    if high is not None:
        ok = ok & (n < high)
    return ok


def any_infinite(*cols: Column) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.abs(c) == float("inf"), F.lit(False))
    return out
