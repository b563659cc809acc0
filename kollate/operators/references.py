"""Diagnostics of reference lists and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kollate.functions import text
from kollate.operators import disparity

#: Words by which a section's kind is told.
SECTIONS = {"in_methods": ("method", "data", "material", "procedur"), "in_intro": ("intro", "background", "literatur", "related work"), "in_discuss": ("discuss", "conclus", "implication"), "in_results": ("result", "finding")}


def inversions(refs: DataFrame, paper: str, surname: str, position: str, least_refs: int = 5, least_ratio: float = 0.7) -> DataFrame:
    """References out of alphabetical order in lists that are in order for the most part.

    Gives (paper, position, surname, previous, previous_position, distance, major): ``previous`` is the largest
    surname before, at its last place; distance is that of the first letters, major from 2 on.
    """
    w = Window.partitionBy(paper).orderBy(position)
    whole = Window.partitionBy(paper)
    named = refs.filter(F.col(surname).isNotNull())
    rising = F.when(F.lag(surname).over(w).isNotNull(), (F.lag(surname).over(w) <= F.col(surname)).cast("double"))
    marked = named.withColumn("_rise", rising).withColumn("_n", F.count("*").over(whole))
    marked = marked.withColumn("_ratio", F.avg("_rise").over(whole)).filter((F.col("_n") >= least_refs) & (F.col("_ratio") >= least_ratio))
    top = F.max(F.struct(F.col(surname).alias("s"), F.col(position).alias("p"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = marked.withColumn("_top", top).filter(F.col(surname) < F.col("_top.s"))
    distance = F.abs(F.ascii(F.col("_top.s")) - F.ascii(F.col(surname)))
    return found.select(paper, position, surname, F.col("_top.s").alias("previous"), F.col("_top.p").alias("previous_position"), distance.alias("distance"), (distance >= 2).alias("major"))


def compare_lists(a: Column, b: Column) -> Column:
    """struct(n_a, n_b, shared, only_a, only_b, jaccard) of two lists of titles; an empty union counts as equal."""
    keys = lambda x: F.array_distinct(F.filter(F.transform(x, text.untagged_title_key), lambda k: F.length(k) > 8))
    x, y = keys(a), keys(b)
    both, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.struct(F.size(x).alias("n_a"), F.size(y).alias("n_b"), both.alias("shared"), F.size(F.array_except(x, y)).alias("only_a"), F.size(F.array_except(y, x)).alias("only_b"), F.when(all_ == 0, 1.0).otherwise(both / all_).alias("jaccard"))


def obscure_old(year: Column, cites: Column, title: Column, citing_year: Column, age: int = 20, most: int = 5) -> Column:
    """Whether a reference is old and hardly cited, or, its count unknown or larger, old without a title."""
    old = (citing_year - year) >= age
    return F.coalesce(old & F.when(cites <= most, True).otherwise(title.isNull() & (year < 1980)), F.lit(False))


def orphans(refs: DataFrame, paper: str, ref: str, title: str, year: str, citing_year: str, least_refs: int = 5, age: int = 15) -> DataFrame:
    """Old references that share no word with any other of their paper.

    A word is counted once per reference; a reference is an orphan if none of its words is in a second one. No
    reference meets another.
    """
    t = refs.filter(F.length(title) > 5).select(paper, ref, title, year, citing_year, text.content_tokens(title).alias("tokens"))
    counts = t.groupBy(paper).agg(F.count("*").alias("n_refs")).filter(F.col("n_refs") >= least_refs)
    t = t.join(counts, paper)
    words = t.select(paper, ref, F.explode("tokens").alias("token"))
    shared = words.groupBy(paper, "token").agg(F.count("*").alias("df")).filter("df > 1").select(paper, "token")
    linked = words.join(shared, [paper, "token"], "left_semi").select(paper, ref).distinct()
    old = t.filter((F.col(citing_year) - F.col(year) >= age) & (F.size("tokens") > 0))
    return old.join(linked, [paper, ref], "left_anti").select(paper, ref, title, year)


def mention_groups(mentions: DataFrame, keys: list[str], section: str) -> DataFrame:
    """Mentions of each reference: count, kinds of section, and the most frequent section (the smallest of several)."""
    flags = [F.bool_or(F.coalesce(text.any_contains(section, words), F.lit(False))).alias(name) for name, words in SECTIONS.items()]
    named = F.coalesce(section, F.lit("UNSPECIFIED"))
    return mentions.groupBy(*keys).agg(F.count("*").alias("mention_count"), *flags, F.mode(named, True).alias("primary_section"))


# Names of the tiers of importance, of sections and of severities.
def importance(count: Column) -> Column:
    return F.when(count == 0, "0 (Uncited in body)").when(count == 1, "1 (Passing citation)").when(count <= 3, "2-3 (Moderate)").when(count <= 6, "4-6 (Substantive)").otherwise("7+ (Foundational)")


def section_group() -> Column:
    return F.when(F.col("in_methods"), "Methods/Data/Materials").when(F.col("in_results"), "Results/Findings").when(F.col("in_discuss"), "Discussion/Conclusions").when(F.col("in_intro"), "Introduction/Background").otherwise("Other/Uncited in body")


def severity(label: Column) -> Column:
    return F.when(label.isin("exact", "punctuation_or_case", "markup_or_entity"), "Type 1 (Surface/Punctuation)").when(label.isin("typographical_variant", "spelling_indel", "cropped_subtitle"), "Type 2 (Textual Variation)").otherwise("Type 3 (Severe Inaccuracy)")


def spectrum(variants: DataFrame, by: list[str], citer: str) -> DataFrame:
    """(k, n_variants, n_citations): how many variants were cited by k papers."""
    k = variants.groupBy(*by).agg(F.countDistinct(citer).alias("k"))
    return k.groupBy("k").agg(F.count("*").alias("n_variants")).withColumn("n_citations", F.col("k") * F.col("n_variants"))


def copying(spectrum_: DataFrame) -> DataFrame:
    """One row: variants, citations, singletons, share read (rho), gamma and alpha of the copying model; null where undefined."""
    one = spectrum_.agg(F.sum("n_variants").alias("n_variants"), F.sum("n_citations").alias("n_citations"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n_variants"))), F.lit(0)).alias("n_single"))
    rho = F.col("n_single") / F.col("n_citations")
    gamma = F.when(rho < 1, rho / (1 - rho))
    return one.select("n_variants", "n_citations", "n_single", F.round(rho, 6).alias("rho"), F.round(gamma, 6).alias("gamma"), F.round(1 + gamma, 6).alias("alpha"))


def reference_links(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(paper, ref, canonical_id, match_tier): references tied to works by DOI, else by a title one work alone has,
    no more than a year apart where both years are known. A reference may have several works by DOI.

    ``refs``: paper, ref, title, doi, year; ``works``: canonical_id, title, doi, reference_year.
    """
    r = refs.select("paper", "ref", text.reference_title_key("title").alias("tk"), text.doi("doi").alias("dk"), F.col("doi").alias("raw"), "year")
    w = works.select("canonical_id", text.reference_title_key("title").alias("wt"), text.doi("doi").alias("wd"), "reference_year")
    by_doi = r.filter(F.length("dk") > 5).join(w, F.col("dk") == F.col("wd")).select("paper", "ref", "canonical_id", F.lit("doi_exact").alias("match_tier"))
    single = w.filter(F.length("wt") >= 20).groupBy("wt").agg(F.count("*").alias("n"), F.min("canonical_id").alias("canonical_id"), F.min("reference_year").alias("reference_year")).filter("n = 1")
    rest = r.filter((F.length("tk") >= 20) & (F.col("raw").isNull() | (F.length(F.trim("raw")) <= 5))).join(by_doi.select("paper", "ref").distinct(), ["paper", "ref"], "left_anti")
    close = F.col("year").isNull() | F.col("reference_year").isNull() | (F.abs(F.col("year") - F.col("reference_year")) <= 1)
    by_title = rest.join(single, F.col("tk") == F.col("wt")).filter(close).select("paper", "ref", "canonical_id", F.lit("title_exact").alias("match_tier"))
    return by_doi.unionByName(by_title)


#: Least age in years and name of the old and hardly cited references of an audit.
OBSCURE = {20: "obscure_20y", 30: "obscure_30y", 50: "obscure_50y", 100: "obscure_100y"}
#: Years by which a reference is younger than its paper for a severe anachronism; citations that count as hardly any.
SEVERE, HARDLY = -5, 5


def _ages(edges: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Edges with their age, and the conditions an audit counts; ``edges``: citer, citing_year, cited_year, cites."""
    aged = edges.filter(F.col("cited_year").isNotNull()).withColumn("age", F.col("citing_year") - F.col("cited_year"))
    age, few = F.col("age"), F.col("cites") <= HARDLY
    return aged, {"anachronisms": age < 0, "severe_anachronisms": age <= SEVERE} | {name: (age >= years) & few for years, name in OBSCURE.items()}


def audit_references(edges: DataFrame) -> DataFrame:
    """One row: how many references of all papers there are, by age and by how much they are cited. ``edges`` as in ``audit_papers``."""
    aged, conditions = _ages(edges)
    age = F.col("age")
    more = {"recent_refs": (age >= 0) & (age < 20), "historical_refs": age >= 20}
    return aged.agg(F.count("*").alias("total_refs"), *[F.count_if(c).alias(name) for name, c in (conditions | more).items()])


def audit_papers(edges: DataFrame) -> DataFrame:
    """One row: how many citing papers have a reference of each kind. ``edges``: citer, citing_year, cited_year, cites.

    Papers are first added up on their own, so that a paper with very many references is one row."""
    aged, conditions = _ages(edges)
    papers = aged.groupBy("citer").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])
    return papers.agg(F.count("*").alias("total_papers"), *[F.count_if(F.col(name)).alias(f"papers_with_{name}") for name in conditions])


def audit_list(refs: DataFrame, paper: str, ref: str, surname: str, position: str, title: str, year: str, citing_year: str, cites: str) -> DataFrame:
    """(paper, ref, finding): what the tests of reference lists find, each as a row: inversions of the alphabetical order, old obscure works
    and old works without a word in common with the rest of the list."""
    turned = inversions(refs, paper, surname, position).join(refs.select(paper, position, ref), [paper, position]).select(paper, ref, F.lit("inversion").alias("finding"))
    old = refs.filter(obscure_old(F.col(year), F.col(cites), F.col(title), F.col(citing_year))).select(paper, ref, F.lit("obscure_old").alias("finding"))
    alone = orphans(refs, paper, ref, title, year, citing_year).select(paper, ref, F.lit("orphan").alias("finding"))
    return turned.unionByName(old).unionByName(alone)


def judged(linked: DataFrame) -> DataFrame:
    """Linked references with title label, its severity, the years' difference, the importance and the section they stand in.

    ``linked``: cited_title, ref_title, cited_year, ref_year, mention_count (null for none) and the flags in_methods, in_results, in_discuss, in_intro.
    """
    label = disparity.title(F.col("cited_title"), F.col("ref_title"))
    gap = disparity.year_gap(F.col("cited_year"), F.col("ref_year"))
    count = F.coalesce("mention_count", F.lit(0))
    flags = {name: F.coalesce(name, F.lit(False)) for name in SECTIONS}
    rows = linked.withColumns({"mention_count": count, **flags, "title_label": label, "year_difference": gap})
    return rows.withColumns({"has_year_disparity": F.coalesce(F.col("year_difference") > 0, F.lit(False)), "title_type": severity(F.col("title_label")), "importance_tier": importance(F.col("mention_count")), "section_group": section_group()})


def accuracy(rows: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """Citations of each group with shares of title labels, types and year differences in per cent, and mean mentions; ``rows`` as from ``judged``."""
    pct = lambda c: F.round(F.avg(c.cast("int")) * 100.0, 2)
    label, kind = F.col("title_label"), F.col("title_type")
    found = rows.groupBy(*by).agg(
        F.count("*").alias("total_citations"), pct(label == "exact").alias("pct_exact_title"), pct(label == "punctuation_or_case").alias("pct_punctuation_case"),
        pct(kind.startswith("Type 1")).alias("pct_type1_surface"), pct(kind.startswith("Type 2")).alias("pct_type2_textual"), pct(kind.startswith("Type 3")).alias("pct_type3_discordant"),
        pct(F.col("has_year_disparity")).alias("pct_year_disparity"), F.round(F.avg("mention_count"), 2).alias("mean_mentions"))
    return found.filter(F.col("total_citations") >= least)


def reference_items(lists: DataFrame, paper: str, items: str) -> DataFrame:
    """(paper, position, title, year, doi): reference lists of cached answers opened. A position that is missing or no number is the
    item's place in the list; a year is made of digits alone. ``items``: array of struct(position, title, year, doi), all text."""
    opened = lists.select(F.col(paper), F.posexplode(items).alias("_i", "_x"))
    year = F.when(F.col("_x.year").rlike(r"^\d+$"), F.col("_x.year")).try_cast("int")
    return opened.select(paper, F.coalesce(F.col("_x.position").try_cast("int"), F.col("_i") + 1).alias("position"), F.col("_x.title").alias("title"), year.alias("year"), F.col("_x.doi").alias("doi"))


def listed_works(lists: DataFrame, paper: str, ids: str, works: DataFrame, key: str, first: int = 100) -> DataFrame:
    """The first ``first`` works that each paper lists by id, with their place in the list and the columns of ``works``; ids without a work are left out."""
    opened = lists.select(F.col(paper), F.posexplode(F.slice(ids, 1, first)).alias("_i", "_id"))
    return opened.join(works, F.col("_id") == works[key]).withColumn("position", F.col("_i") + 1).drop("_i", "_id")
