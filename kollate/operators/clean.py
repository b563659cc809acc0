"""Cleaning of field values with a record of which steps changed or repaired them.

A ``Cleaner`` has steps that always run (canonical), steps that run only where the value is not yet
well-formed (battery), and a test of well-formedness. The codes tell which canonical steps changed the
value, and which battery steps a repair can't do without: a battery step is listed where leaving it out
leaves the value malformed. A value that the whole battery can't mend keeps the battery's output and
lists none of its steps. Null stays null and is not checked (well-formed is null).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kollate.functions import checksum, text
from kollate.functions.udfs import fold


@dataclass(frozen=True)
class Step:
    """One change: its code (empty for one that is not reported) and what it does to a column."""

    code: str
    apply: Callable[[Column], Column]


@dataclass(frozen=True)
class Cleaner:
    canonical: tuple[Step, ...]
    battery: tuple[Step, ...]
    wellformed: Callable[[Column], Column]

    def clean(self, raw: Column) -> Column:
        """struct(value, wellformed, codes)."""
        chain = [raw]
        for step in self.canonical:
            chain.append(step.apply(chain[-1]))
        base = chain[-1]
        fine = F.coalesce(self.wellformed(base), F.lit(False))
        run = lambda steps: reduce(lambda c, s: s.apply(c), steps, base)
        mended = run(self.battery)
        works = F.coalesce(self.wellformed(mended), F.lit(False))
        coded = [F.when(~a.eqNullSafe(b), F.lit(s.code)) for s, a, b in zip(self.canonical, chain, chain[1:]) if s.code]
        for i, step in enumerate(self.battery):
            rest = run(self.battery[:i] + self.battery[i + 1 :])
            needed = ~fine & works & ~F.coalesce(self.wellformed(rest), F.lit(False))
            coded.append(F.when(needed, F.lit(step.code)))
        codes = F.filter(F.array(*coded), lambda c: c.isNotNull()) if coded else F.array().cast("array<string>")
        value = F.when(fine, base).otherwise(mended)
        return F.when(raw.isNotNull(), F.struct(value.alias("value"), (fine | works).alias("wellformed"), codes.alias("codes")))


def _step(code: str, pattern: str, to: str = "") -> Step:
    return Step(code, lambda c: F.regexp_replace(c, pattern, to))


LOWER = Step("", F.lower)
STRIP = Step("K", text.strip)
#: The prefix goes first and must stand at the very start; blanks go second.
DOI = Cleaner((LOWER,), (_step("S", text.DOI_PREFIX), STRIP), lambda c: c.rlike(r"^10\.\d{4,}(?:\.\d+)*/\S+$"))
ISBN = Cleaner((), (STRIP, _step("R", r"[^0-9Xx-]")), checksum.book_number)
ISSN = Cleaner((), (STRIP, Step("R", lambda c: F.regexp_replace(c, r"^([0-9]{4})[^0-9Xx]?([0-9]{3}[0-9Xx])$", "$1-$2"))), checksum.issn)
STANDARD_NUMBER = Cleaner((), (STRIP, _step("R", r"[^0-9Xx-]")), checksum.standard_number)
IDENTIFIER = Cleaner((), (STRIP, Step("R", F.upper)), lambda c: c.rlike(r"^(?:WOS|MEDLINE|BCI|ZOOREC):\d+$"))
NUMERIC = Cleaner((), (STRIP, _step("R", r"[,\s]")), lambda c: c.rlike(r"^\d+$"))
YEAR = Cleaner((), (STRIP,), lambda c: c.rlike(r"^(?:1[5-9]|20)\d{2}$"))

#: Signs written as one quotation mark or hyphen.
QUOTES, DASHES = "‘’‚‛“”„‟«»‹›`´\"", "‐‑‒–—―−"
_COLLAPSE, _FULL_STOP = _step("K", r"(?U)\s+", " "), _step("R", r"\.\s*$")
_TEXT_BATTERY = (Step("K", lambda c: text.strip(F.regexp_replace(c, r"(?U)\s+", " "))), _FULL_STOP)


def free_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds struct(value, wellformed, codes) of a free text: folded, lower-cased, blanks and full stop mended.

    Composition and compatibility folding need one vectorised function; all else are expressions.
    """
    folded = df.withColumn("_f", fold(F.col(column)))
    zero_width = lambda c: F.regexp_replace(c, "[\\u200b\\u200c\\u200d\\u2060\\ufeff]", "")
    steps = [
        ("S", F.col("_f.nfc"), zero_width(F.col("_f.nfc"))),
        ("K", F.col("_f.nfc"), F.col("_f.spaces")),
        ("Q", F.col("_f.spaces"), F.col("_f.other")),
    ]
    base = zero_width(F.col("_f.other"))
    quoted = F.translate(base, QUOTES, "'" * len(QUOTES))
    dashed = F.translate(quoted, DASHES, "-" * len(DASHES))
    steps += [("R", base, quoted), ("R", quoted, dashed)]
    lowered = F.lower(dashed)
    battery = reduce(lambda c, s: s.apply(c), _TEXT_BATTERY, lowered)
    codes = [F.when(~a.eqNullSafe(b), F.lit(code)) for code, a, b in steps]
    for i, step in enumerate(_TEXT_BATTERY):
        rest = reduce(lambda c, s: s.apply(c), _TEXT_BATTERY[:i] + _TEXT_BATTERY[i + 1 :], lowered)
        again = reduce(lambda c, s: s.apply(c), _TEXT_BATTERY, rest)
        codes.append(F.when((lowered != battery) & (rest != again), F.lit(step.code)))
    kept = F.filter(F.array(*codes), lambda c: c.isNotNull())
    found = F.when(F.col(column).isNotNull(), F.struct(battery.alias("value"), F.lit(True).alias("wellformed"), kept.alias("codes")))
    return folded.withColumn(out, found).drop("_f")


def leaked_path(value: Column) -> Column:
    """D where a vocabulary's own path stands in place of its label."""
    return F.when(value.rlike("^/[a-z0-9/]+$"), F.array(F.lit("D"))).otherwise(F.array().cast("array<string>"))


def numeric_descriptor(value: Column) -> Column:
    """struct(is_numeric, codes): prose in place of a number is D."""
    number = text.strip(value).rlike(r"^[0-9]+(?:\.[0-9]+)?$")
    prose = ~number & ((F.length(value) > 15) | value.contains(":"))
    return F.when(value.isNotNull(), F.struct(number.alias("is_numeric"), F.filter(F.array(F.when(prose, F.lit("D"))), lambda c: c.isNotNull()).alias("codes")))


def in_vocabulary(df: DataFrame, value: str, kind: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Adds whether a category belongs to its record's type; null for a type the vocabulary doesn't know.

    ``vocabulary``: kind, label. Labels are compared without case and signs.
    """
    known = vocabulary.select(F.col("kind").alias("_k"), text.label_key("label").alias("_l")).distinct()
    kinds = known.select(F.col("_k").alias("_k2")).distinct()
    joined = df.join(kinds, df[kind] == F.col("_k2"), "left").join(known.withColumn("_hit", F.lit(True)), (df[kind] == F.col("_k")) & (text.label_key(value) == F.col("_l")), "left")
    return joined.withColumn(out, F.when(F.col("_k2").isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_k", "_l", "_k2", "_hit")


def consensus_vocabulary(df: DataFrame, key: str, value: str, sentinel: str = "00000") -> DataFrame:
    """(key, value): the most frequent plain value of each key; of equally frequent ones the smallest."""
    clean = text.null_if_blank(F.regexp_replace(text.strip(F.regexp_replace(F.lower(F.col(value)), r"(?U)\s+", " ")), r"\.$", ""))
    counted = df.filter((F.col(key) != sentinel) & F.col(key).isNotNull()).select(F.col(key).alias("key"), clean.alias("value")).dropna().groupBy("key", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def index_title_codes(title: Column, unescaped: Column) -> Column:
    """Codes of one title by itself: E blank; Q markup, entity or TeX; F dots at the end; K blanks in a row."""
    blank = ~text.present(title)
    codes = F.array(
        F.when((unescaped != title) | title.rlike(r"<[^>]+>|\$[^$]+\$|\\[a-zA-Z]+"), F.lit("Q")),
        F.when(title.rlike(r"\s*\.\.+$"), F.lit("F")),
        F.when(title.rlike(r"\s{2,}"), F.lit("K")),
    )
    return F.when(F.coalesce(blank, F.lit(True)), F.array(F.lit("E"))).otherwise(F.filter(codes, lambda c: c.isNotNull()))


#: Which cleaner a field has, by record type or for all.
REGISTRY: dict[tuple[str, str | None], Cleaner] = {("doi", None): DOI, ("isbn", None): ISBN, ("outlet_isbn", None): ISBN, ("issn", None): ISSN, ("identifier", None): IDENTIFIER, ("pages", None): NUMERIC, ("reference_year", None): YEAR}


def cleaner(field: str, kind: str | None = None) -> Cleaner | None:
    """The cleaner of a field for a type, else the one for all types."""
    return REGISTRY.get((field, kind)) or REGISTRY.get((field, None))
