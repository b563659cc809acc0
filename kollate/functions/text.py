"""Normalisers and small scalar rules, all of them column expressions that stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Words that stand for a missing value in descriptive fields.
DISGUISED_NULLS = ("unknown", "null", "n/a", "na", "none", "-")
#: Openings of a DOI.
DOI_PREFIX = r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
#: Words of corporate names.
CORPORATE = ("department", "committee", "group", "team", "university", "institute", "centre", "center", "commission", "association", "society", "ministry", "office", "working party", "consortium", "taskforce", "hospital", "board", "panel", "australia", "national", "csiro", "authority", "division", "faculty", "school")
#: Words that say nothing about a subject.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "as", "is", "are", "was", "were", "from", "that", "this", "between", "into", "through", "after", "before", "using", "study", "analysis", "role")

_C = Column | str


def _c(x: _C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: _C) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def present(x: _C) -> Column:
    """Neither null nor blank."""
    return _c(x).isNotNull() & (F.length(F.trim(_c(x))) > 0)


def presence(x: _C) -> Column:
    """``missing`` for null, blank and words that stand for a missing value, else ``present``."""
    return F.when(present(x) & ~F.lower(strip(x)).isin(*DISGUISED_NULLS), "present").otherwise("missing")


def null_if_blank(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def title_words(x: _C) -> Column:
    """Lower case; anything but ASCII letters, digits and blanks becomes a blank; blanks collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_key(x: _C) -> Column:
    """ASCII letters and digits alone, of the trimmed lower-case title."""
    return F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-z0-9]", "")


def untagged_title_key(x: _C) -> Column:
    """The same after tags were dropped."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(x), "<[^>]+>", "")), "[^a-z0-9]", "")


def reference_title_key(x: _C) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(x), "[^a-zA-Z0-9]", "")))


def plain_title(x: _C) -> Column:
    return F.trim(F.lower(_c(x)))


def unicode_title_words(x: _C) -> Column:
    """Like title_words, but letters of any alphabet count."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def doi(x: _C) -> Column:
    """Trimmed and lower case, without one leading label or resolver; null if blank."""
    return null_if_blank(F.regexp_replace(F.lower(strip(x)), DOI_PREFIX, ""))


def doi_any_labels(x: _C) -> Column:
    """The same with all leading labels dropped."""
    return null_if_blank(F.regexp_replace(F.lower(strip(x)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*|doi\s+)+", ""))


def number_key(x: _C) -> Column:
    """Digits and X of an ISBN or ISSN; null if there are none."""
    return null_if_blank(F.upper(F.regexp_replace(_c(x), "[^0-9Xx]", "")))


def isbn(x: _C) -> Column:
    """The same where it has the length of an ISBN, else null."""
    return F.when(F.length(number_key(x)).isin(10, 13), number_key(x))


def isbn_or_outlet(isbn_: _C, outlet: _C) -> Column:
    """The item's number, else the outlet's; an emptied number still counts as one."""
    clean = lambda x: F.regexp_replace(_c(x), "[^0-9Xx]", "")
    return F.coalesce(clean(isbn_), clean(outlet))


def digits_id(x: _C) -> Column:
    """The digits of an id written as an address, as a number."""
    return F.regexp_replace(_c(x), "[^0-9]", "").try_cast("long")


def year_in(x: _C) -> Column:
    """The first four digits in a row, as a number; null if there are none."""
    return F.regexp_extract(_c(x), "[0-9]{4}", 0).try_cast("int")


def word_count(x: _C) -> Column:
    return F.size(F.split(_c(x), " "))


def listed(x: _C, sep: str = ";") -> Column:
    """How many parts a delimited list has; none if blank."""
    return F.when(present(x), F.length(_c(x)) - F.length(F.replace(_c(x), F.lit(sep), F.lit(""))) + 1).otherwise(0)


def parts(x: _C, sep: str = ";", least: int = 3) -> Column:
    """Trimmed parts of a delimited list that have at least so many signs."""
    return F.filter(F.transform(F.split(_c(x), sep), F.trim), lambda p: F.length(p) >= least)


def without_the(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"(?i)^the\s+", "")))


def shares_any(a: Column, b: Column) -> Column:
    """Whether two lists share a value; a null list or value shares nothing."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def institution(x: _C) -> Column:
    """Institution name without a leading article and punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(_c(x))), r"^the\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", ""), r"\s+", " "))


def label_key(x: _C) -> Column:
    return F.lower(F.regexp_replace(_c(x), "[^a-zA-Z0-9]", ""))


def name_token(x: _C) -> Column:
    """A name without years and signs, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(_c(x), r"\b[0-9]{4}\b-?", ""), r"[^a-zA-Z\s]", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def corporate(x: _C) -> Column:
    return _c(x).rlike(r"(?i)\b(" + "|".join(CORPORATE) + r")\b")


def family_given(x: _C) -> tuple[Column, Column]:
    """Family and given names of "Family, Given" or "Given Family"."""
    text = F.trim(_c(x))
    comma = F.instr(text, ",") > 0
    family = F.when(comma, F.trim(F.split_part(text, F.lit(","), F.lit(1)))).otherwise(F.split_part(text, F.lit(" "), F.lit(-1)))
    given = F.when(comma, F.trim(F.regexp_replace(text, "^[^,]*,", ""))).otherwise(F.trim(F.regexp_replace(text, r"\s*\S+$", "")))
    return family, given


def first_surname(x: _C) -> Column:
    """Surname of the first of authors divided by semicolons, in capitals: before a comma; the first word, if it has three letters at
    least and the last has two at most without its dots; else the last word."""
    first = strip(F.split_part(_c(x), F.lit(";"), F.lit(1)))
    words = F.split(first, r"(?U)\s+")
    last = F.regexp_replace(F.try_element_at(words, F.lit(-1)), r"\.+$", "")
    initials = (F.size(words) >= 2) & (F.length(last) <= 2) & (F.length(F.try_element_at(words, F.lit(1))) > 2)
    picked = F.when(F.contains(first, F.lit(",")), F.split_part(first, F.lit(","), F.lit(1))).when(initials, F.try_element_at(words, F.lit(1))).otherwise(F.try_element_at(words, F.lit(-1)))
    return null_if_blank(F.upper(F.regexp_replace(picked, "[^a-zA-Z]", "")))


#: Parts of addresses by how freely they can be read; others come last.
OPEN_ADDRESSES = (
    ("arxiv.org", "journals.plos.org", "frontiersin.org", "mdpi.com", "biomedcentral.com", "europepmc.org"),
    ("edu.au", "anu.edu", "usyd.edu", "unsw.edu", "uq.edu", "unimelb.edu", "curtin.edu", "qut.edu", "monash.edu", "adelaide.edu"),
    ("zenodo.org", "figshare.com", "osf.io", "biorxiv.org", "medrxiv.org", "researchgate.net"),
)


def address_tier(x: _C) -> Column:
    """0 for open sources, 1 for university repositories, 2 for other repositories, 3 for all else; the first that holds."""
    out = F.lit(len(OPEN_ADDRESSES))
    for tier, parts in reversed(list(enumerate(OPEN_ADDRESSES))):
        out = F.when(any_contains(x, parts), tier).otherwise(out)
    return out


def content_tokens(x: _C) -> Column:
    """Different words of three ASCII letters or more, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def before_person_ids(year: _C) -> Column:
    """Whether a year lies before person identifiers were issued; unknown years don't."""
    return F.coalesce(_c(year) <= 2011, F.lit(False))


def contribution_kind(x: _C) -> Column:
    """Catalogue type to category; the first rule that holds wins."""
    text = F.lower(F.coalesce(_c(x), F.lit("")))
    rules = (("thesis", "Thesis"), ("chapter", "Book Chapter"), ("book", "Book"), ("conference", "Conference"), ("review", "Review"), ("article", "Article"), ("video", "Creative Work"), ("sound", "Creative Work"), ("music", "Creative Work"))
    out = None
    for word, label in rules:
        out = F.when(text.contains(word), label) if out is None else out.when(text.contains(word), label)
    return out.otherwise("Other")


def any_contains(x: _C, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(_c(x)).contains(w) for w in words))


def pmc_number(url: _C) -> Column:
    return null_if_blank(F.regexp_extract(_c(url), r"(?i)PMC(\d+)", 1)).try_cast("long")


def figshare_id(url: _C) -> Column:
    return null_if_blank(F.regexp_extract(_c(url), r"(?:articles/(?:[^/]+/)*|ndownloader/files/|figshare\.)(\d+)", 1)).try_cast("long")


def host(url: _C) -> Column:
    return null_if_blank(F.regexp_extract(_c(url), r"^https?://(?:www\.)?([^/:]+)", 1))


def doi_slug(doi_: _C) -> Column:
    """The DOI as it may stand in a file name."""
    return F.regexp_replace(doi(doi_), "[^a-z0-9]+", "_")


def pdf_candidates(*urls: _C) -> Column:
    """Addresses in their order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.array(*map(_c, urls)), lambda u: u.isNotNull() & (F.length(F.trim(u)) > 0)))


def search_phrase(title: _C) -> Column:
    """A title as a phrase for an index's search, without operators and quotes."""
    bare = F.regexp_replace(F.regexp_replace(_c(title), r'["{}()\[\]?*:;]', " "), r"(?i)\b(and|or|not)\b", " ")
    return F.concat(F.lit('TITLE("'), F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit('")'))


def candidate_score(exact: Column, year_close: Column, rank: Column) -> Column:
    """100 for an equal title, else 50; 20 for a close year; 5 less for each rank."""
    return F.when(exact, 100).otherwise(50) + F.when(F.coalesce(year_close, F.lit(False)), 20).otherwise(0) - 5 * F.coalesce(rank, F.lit(0))
