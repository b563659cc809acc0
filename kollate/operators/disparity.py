"""Classification of pairwise metadata differences. The first rule that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from kollate.functions import text

#: What may stand between title and subtitle, right-stripped where it is appended.
SUBTITLE_MARKS = (":", " -", " --", " —", " /")
#: Label, code.
CODES = {"omitted": "E", "exact": None, "markup_or_entity": "Q", "cropped_subtitle": "F", "punctuation_or_case": "R", "spelling_indel": "B", "discordant": "D", "typographical_variant": "A"}


def cropped(a: Column, b: Column) -> Column:
    """Whether one title is the other up to a subtitle mark."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    first = F.length(x) < F.length(y)
    short, long_ = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)
    rules = []
    for mark in SUBTITLE_MARKS:
        rules.append(F.startswith(long_, F.concat(short, F.lit(mark))))
        rules.append(F.trim(F.substring_index(long_, mark.strip(), 1)) == short)
    return (x != y) & reduce(lambda p, q: p | q, rules)


def one_sign_apart(a: Column, b: Column) -> Column:
    """Whether adding one sign to one text gives the other: one edit, and one sign of length, apart."""
    return (F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b, 1) == 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the different words of two texts."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def title(a: Column, b: Column, unescaped_a: Column | None = None, unescaped_b: Column | None = None, subtitle_first: bool = True) -> Column:
    """Label of a title difference.

    ``subtitle_first``: the rule of the cropped subtitle comes before punctuation, and punctuation is dropped;
    otherwise it comes after, and punctuation becomes a blank. Unescaped texts may be left out where no
    entities occur.
    """
    ua, ub = (a if unescaped_a is None else unescaped_a), (b if unescaped_b is None else unescaped_b)
    to = "" if subtitle_first else " "
    signs = r"(?U)[^\w\s]" if subtitle_first else r"[^a-zA-Z0-9\s]"
    plain = lambda c: F.lower(text.strip(F.regexp_replace(F.regexp_replace(c, signs, to), r"(?U)\s+", " ")))
    pa, pb = plain(ua), plain(ub)
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    entity = ((ua != a) | (ub != b)) & ((ua == ub) | (F.lower(text.strip(ua)) == F.lower(text.strip(ub))))
    order = [("cropped_subtitle", cropped(a, b)), ("punctuation_or_case", pa == pb)]
    out = F.when(empty(a) | empty(b), "omitted").when(a == b, "exact").when(entity, "markup_or_entity")
    for label, rule in order if subtitle_first else order[::-1]:
        out = out.when(rule, label)
    out = out.when(one_sign_apart(pa, pb), "spelling_indel")
    return out.when((F.length(pa) > 0) & (F.length(pb) > 0) & (jaccard(pa, pb) < 0.25), "discordant").otherwise("typographical_variant")


def codes(label: Column) -> Column:
    """The code of a label, as a list."""
    known = F.create_map(*[F.lit(x) for k, v in CODES.items() if v for x in (k, v)])
    return F.when(label == "exact", F.array().cast("array<string>")).otherwise(F.array(known[label]))


def year_gap(a: Column, b: Column) -> Column:
    """Years between; null if one is unknown."""
    return F.abs(a.cast("int") - b.cast("int"))


def year_codes(a: Column, b: Column) -> Column:
    gap = year_gap(a, b)
    return F.when(gap.isNull(), F.array(F.lit("E"))).when(gap == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("T")))


def doi_label(a: Column, b: Column) -> Column:
    x, y = text.doi(a), text.doi(b)
    return F.when(x.isNull() & y.isNull(), "both_missing").when(x.isNull() | y.isNull(), "omitted").when(x == y, "exact").otherwise("discordant")


def doi_code(label: Column) -> Column:
    return F.when(label == "omitted", "E").when(label == "discordant", "D").otherwise("")


def isbn_label(a: Column, b: Column, left: str = "left", right: str = "right") -> Column:
    x, y = text.isbn(a), text.isbn(b)
    return F.when(x.isNull() & y.isNull(), "both_omitted").when(y.isNull(), f"omitted_in_{right}").when(x.isNull(), f"omitted_in_{left}").when(x == y, "exact").otherwise("conflict")


def profile(has_title: Column, gap: Column, has_doi: Column) -> Column:
    """One of eight combinations of title, year and DOI differences."""
    t, d = F.coalesce(has_title, F.lit(False)), F.coalesce(has_doi, F.lit(False))
    y = F.coalesce(gap > 0, F.lit(False))
    return (
        F.when(y & d & ~t, "coupled_lifecycle_drift").when(y & d, "coupled_with_title_disp")
        .when(t & y, "title_and_year_disp").when(t & d, "title_and_doi_disp")
        .when(t, "isolated_title_disp").when(y, "isolated_year_disp").when(d, "isolated_doi_disp").otherwise("clean")
    )


def coupled(gap: Column, has_doi: Column) -> Column:
    return F.coalesce(gap > 0, F.lit(False)) & F.coalesce(has_doi, F.lit(False))


def version_drift(locations: Column) -> Column:
    """struct of versions and sources of a work's locations; ``locations``: array of structs with version and source_name."""
    kept = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform(locations, lambda x: x[name]), lambda v: v.isNotNull() & (v != ""))))
    versions, sources = kept("version"), kept("source_name")
    has = lambda v: F.array_contains(versions, v)
    return F.struct((F.size(versions) > 1).alias("several_versions"), (F.size(sources) > 1).alias("several_sources"), versions.alias("versions"), sources.alias("sources"), has("submittedVersion").alias("submitted"), has("acceptedVersion").alias("accepted"), has("publishedVersion").alias("published"))


def authorship_drift(a: Column, b: Column) -> Column:
    """struct(count_difference, reordered, affiliations_changed) of two lists of struct(author_id, affiliations)."""
    ids = lambda x: F.filter(F.transform(x, lambda p: p["author_id"]), lambda i: i.isNotNull())
    common = F.array_intersect(ids(a), ids(b))
    seq = lambda x: F.filter(ids(x), lambda i: F.array_contains(common, i))
    places = lambda x: F.array_sort(F.array_distinct(F.flatten(F.transform(x, lambda p: F.coalesce(p["affiliations"], F.array().cast("array<string>"))))))
    pa, pb = places(a), places(b)
    return F.struct(F.abs(F.size(a) - F.size(b)).alias("count_difference"), ((F.size(common) >= 2) & (seq(a) != seq(b))).alias("reordered"), ((F.size(pa) > 0) & (F.size(pb) > 0) & (pa != pb)).alias("affiliations_changed"))
