"""Check digits of standard numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _digit(ch: Column) -> Column:
    return F.when(F.upper(ch) == "X", 10).otherwise(ch.cast("int"))


def _weighted(text: Column, weight) -> Column:
    """Sum of each sign's value times weight(position from 0)."""
    signs = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: _digit(F.substring(text, i, F.lit(1))) * weight(i - 1))
    return F.aggregate(signs, F.lit(0), lambda a, b: a + b)


def issn(value: Column) -> Column:
    """Four digits, hyphen, three digits and a check sign, modulo 11."""
    bare = F.replace(value, F.lit("-"), F.lit(""))
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{3}[0-9Xx]$"), _weighted(bare, lambda i: 8 - i) % 11 == 0).otherwise(False)


def isbn10(value: Column) -> Column:
    bare = F.regexp_replace(value, r"[-\s]", "")
    return F.when(bare.rlike("^[0-9]{9}[0-9Xx]$"), _weighted(bare, lambda i: 10 - i) % 11 == 0).otherwise(False)


def ean13(value: Column) -> Column:
    bare = F.regexp_replace(value, r"[-\s]", "")
    return F.when(bare.rlike("^[0-9]{13}$"), _weighted(bare, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0).otherwise(False)


def book_number(value: Column) -> Column:
    return isbn10(value) | ean13(value)


def standard_number(value: Column) -> Column:
    return book_number(value) | issn(value)
