"""Structural signs in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Years from 1500 to 2049, two blanks at most beside two signs of a dash at most.
_YEAR, _DASH = r"(?:1[5-9]\d{2}|20[0-4]\d)", "[-‐‑‒–—―−_]{0,2}"
_RANGE = rf"{_YEAR}(?U:\s){{0,2}}{_DASH}(?U:\s){{0,2}}{_YEAR}"
#: A small list of spellings by dialect; full dictionaries are not part of this library.
US_WORDS = ("color", "behavior", "center", "organization", "labor", "analyze", "modeling", "fiber", "program")
GB_WORDS = ("colour", "behaviour", "centre", "organisation", "labour", "analyse", "modelling", "fibre", "programme")


def html_tag(text: Column) -> Column:
    return text.rlike(r"</?[a-zA-Z][a-zA-Z0-9]*\s*/?>")


def tex_command(text: Column) -> Column:
    return text.rlike(r"\\[a-zA-Z]+")


def non_latin(text: Column) -> Column:
    """Whether a letter of another alphabet than the Latin occurs."""
    return text.rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}]]")


def year_range(text: Column) -> Column:
    """``valid`` for dddd-dddd, ``adjusted`` for other ranges of two years, null for none."""
    found = F.regexp_extract(text, _RANGE, 0)
    return F.when(found.rlike(r"^\d{4}-\d{4}$"), "valid").when(F.length(found) > 0, "adjusted")


def read_as_latin(text: Column) -> Column:
    """Approximation: whether UTF-8 read in a one-byte encoding stands in the text."""
    return text.rlike("[ÃÂÎÏÐÑ][\\x{80}-\\x{BF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€|ï¿½")


def dialect(text: Column) -> Column:
    """struct(us, gb) of whole words of the two lists."""
    any_of = lambda words: text.rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    return F.struct(any_of(US_WORDS).alias("us"), any_of(GB_WORDS).alias("gb"))
