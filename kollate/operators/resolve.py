"""Duplicate submissions to canonical entities: ties, groups and golden values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kollate.functions import text
from kollate.operators import disparity
from kollate.session import cut


def star(members: DataFrame, key: str, node: str) -> DataFrame:
    """(u, v): each node of a key tied to the key's smallest, so that a key has as many ties as members."""
    m = members.select(F.col(key).alias("k"), F.col(node).alias("v")).dropna().distinct()
    least = m.groupBy("k").agg(F.min("v").alias("u"), F.max("v").alias("w")).filter("u < w").select("k", "u")
    return m.join(least, "k").filter("u < v").select("u", "v").distinct()


def components(nodes: DataFrame, node: str, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node; the component is its smallest node.

    In a round every root hooks to its smallest neighbour and takes that one's root, however long the way; ties within a
    tree are then dropped. A root that nothing hooked to has a neighbour with a smaller root and hooks in the next round, so
    two rounds halve the roots that have ties at least. Tables of a round are written to the shared folder. Raises
    when ties are left after ``rounds``.
    """
    labels = cut(nodes.select(F.col(node).alias("n")).distinct().withColumn("label", F.col("n")), "labels")
    known = labels.select("n")
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).filter("a <> b")
    for side in ("a", "b"):
        both = both.join(known, F.col(side) == F.col("n"), "left_semi")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    for _ in range(rounds):
        if both.isEmpty():
            break
        parents = cut(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("m"), F.least("a", "near").alias("p")), "parents")
        for _ in range(rounds):  # the way to the root halves each time
            upper = parents.select(F.col("m").alias("q"), F.col("p").alias("far"))
            after = cut(parents.join(upper, F.col("p") == F.col("q")).select("m", F.col("p").alias("old"), F.col("far").alias("p")), "parents")
            parents = after.select("m", "p")
            if after.filter("old <> p").isEmpty():
                break
        else:
            raise RuntimeError(f"roots were not reached in {rounds} jumps")
        labels = cut(labels.join(parents, F.col("label") == F.col("m"), "left").select("n", F.coalesce("p", "label").alias("label")), "labels")
        for side in ("a", "b"):
            both = both.join(parents, F.col(side) == F.col("m")).drop(side, "m").withColumnRenamed("p", side)
        both = cut(both.filter("a <> b").distinct(), "both")
    else:
        if not both.isEmpty():
            raise RuntimeError(f"labels did not settle in {rounds} rounds")
    return labels.select(F.col("n").alias(node), F.col("label").alias("component"))


def submission_ties(rows: DataFrame) -> DataFrame:
    """(u, v) of submissions that are one work: equal well-formed DOI; equal well-formed identifier; equal type
    and title of two words at least whose group has one valid DOI at most.

    ``rows``: id, kind, title, doi, doi_wellformed, identifier, identifier_wellformed.
    """
    by_doi = star(rows.filter("doi_wellformed").select("id", F.lower("doi").alias("k")), "k", "id")
    by_identifier = star(rows.filter("identifier_wellformed").select("id", F.col("identifier").alias("k")), "k", "id")
    titled = rows.select("id", F.concat_ws("\u0001", "kind", F.lower(text.strip("title"))).alias("k"), F.lower(text.strip("title")).alias("t"), F.when(F.col("doi_wellformed"), F.lower("doi")).alias("d"))
    titled = titled.filter(F.size(F.split("t", r"(?U)\s+")) >= 2)
    clear = titled.groupBy("k").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is null or a = b").select("k")
    by_title = star(titled.join(clear, "k", "left_semi"), "k", "id")
    return by_doi.unionByName(by_identifier).unionByName(by_title)


def golden(rows: DataFrame, group: str, value: str, position: str, longest: bool = True) -> DataFrame:
    """(group, value) of each group's most frequent value; then the longest, if asked for; then the first seen."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    size = F.length(F.col(value).cast("string")) if longest else F.lit(0)
    return counted.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), -size, F.col("p"))).alias(value))


def canonical(rows: DataFrame, group: str = "component") -> DataFrame:
    """One golden record per group of submissions, with codes of how its members differ.

    ``rows``: id, component, kind, institution, title, doi, doi_wellformed, reference_year, outlet. Ties of
    frequency go to the longest title or outlet, then to the smallest id.
    """
    facts = rows.groupBy(group).agg(
        F.min("id").alias("canonical_id"), F.array_sort(F.collect_set("id")).alias("source_ids"), F.array_sort(F.collect_set("institution")).alias("institutions"), F.count("*").alias("n_submissions"),
        F.min_by("kind", "id").alias("kind"), F.bool_or(F.coalesce("doi_wellformed", F.lit(False))).alias("doi_wellformed"),
        F.bool_and(text.present("doi")).alias("all_doi"), F.bool_or(text.present("doi")).alias("any_doi"),
        F.countDistinct(F.when(F.col("doi_wellformed"), F.lower("doi"))).alias("n_doi"), F.countDistinct("reference_year").alias("n_year"), F.countDistinct("title").alias("n_title"), F.countDistinct("outlet").alias("n_outlet"),
    )
    valid = golden(rows.withColumn("doi", F.when(F.col("doi_wellformed"), F.lower("doi"))), group, "doi", "id", longest=False).withColumnRenamed("doi", "valid_doi")
    raw = golden(rows.withColumn("doi", F.when(text.present("doi"), F.col("doi"))), group, "doi", "id", longest=False).withColumnRenamed("doi", "raw_doi")
    out = facts
    for found in (valid, raw, golden(rows, group, "title", "id"), golden(rows, group, "outlet", "id"), golden(rows, group, "reference_year", "id", longest=False)):
        out = out.join(found, group, "left")
    codes = F.filter(F.array(
        F.when(F.col("any_doi") & ~F.col("all_doi"), F.lit("E")), F.when(F.col("n_doi") > 1, F.lit("D")),
        F.when(F.col("n_year") > 1, F.lit("T")), F.when(F.col("n_outlet") > 1, F.lit("R"))), lambda c: c.isNotNull())
    return out.select("canonical_id", "source_ids", "institutions", "n_submissions", (F.col("n_submissions") > 1).alias("several"), "kind", "title", F.coalesce("valid_doi", "raw_doi").alias("doi"), "doi_wellformed", "reference_year", "outlet", codes.alias("codes"), (F.col("n_title") > 1).alias("title_differs"), (F.col("n_doi") > 1).alias("doi_differs"), (F.col("n_year") > 1).alias("year_differs"), (F.col("n_outlet") > 1).alias("outlet_differs"))


def title_code(a: Column, b: Column) -> Column:
    """Code of a member's title against the golden one: sign added or left out, punctuation, or else."""
    x, y = F.lower(text.strip(a)), F.lower(text.strip(b))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))
    return F.when(x == y, None).when(disparity.one_sign_apart(x, y), "B").when(bare(x) == bare(y), "R").otherwise("A")


def repair_truncated(rows: DataFrame, value: str, key: str, width: int) -> DataFrame:
    """Values of just ``width`` signs are cut; one that a single longer or other value continues takes that value.

    Adds ``repaired`` and ``cut`` (code F or null). Both sides are made different first and blocked by the
    first half of the width, so no value meets all others.
    """
    short = rows.select(F.col(value).alias("s")).filter(F.length("s") == width).distinct().withColumn("p", F.left(F.col("s"), F.lit(width // 2)))
    whole = rows.select(F.col(value).alias("w")).filter(F.length("w") != width).distinct().withColumn("p", F.left(F.col("w"), F.lit(width // 2)))
    found = short.join(whole, "p").filter(F.startswith(F.col("w"), F.col("s"))).groupBy("s").agg(F.min("w").alias("one"), F.max("w").alias("other")).filter("one = other").select(F.col("s").alias("__s"), F.col("one").alias("__one"))
    joined = rows.join(found, rows[value] == F.col("__s"), "left")
    return joined.withColumn("repaired", F.coalesce("__one", F.col(value))).withColumn("cut", F.when(F.length(value) == width, "F")).drop("__s", "__one")


def repair_indels(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Within a group, a title that lacks one sign of another takes the other: of several the most frequent, then the first.

    Adds ``repaired`` and ``indel`` (K a blank, B a letter or digit, R else, or null). Only different titles
    are paired, and only those of neighbouring length.
    """
    t = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    a = t.select(F.col(group).alias("g"), F.col(value).alias("a"), F.length(value).alias("la"))
    b = t.select(F.col(group).alias("g"), F.col(value).alias("b"), (F.length(value) - 1).alias("la"), "n")
    near = a.join(b, ["g", "la"]).filter(disparity.one_sign_apart(F.col("a"), F.col("b")))
    picked = near.groupBy("g", "a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b"))
    k = F.array_max(F.filter(F.sequence(F.lit(0), F.length("a")), lambda i: F.left(F.col("a"), i) == F.left(F.col("b"), i)))
    sign = F.substring(F.col("b"), k + 1, F.lit(1))
    code = F.when(sign.rlike(r"(?U)\s"), "K").when(sign.rlike(r"(?U)[\p{L}\p{N}]"), "B").otherwise("R")
    picked = picked.select(F.col("g").alias("__g"), F.col("a").alias("__a"), F.col("b").alias("__b"), code.alias("indel"))
    joined = rows.join(picked, (rows[group] == F.col("__g")) & (rows[value] == F.col("__a")), "left")
    return joined.withColumn("repaired", F.coalesce("__b", F.col(value))).drop("__g", "__a", "__b")


def duplicate_groups(rows: DataFrame, kind: str, title: str, institution: str, key: str) -> DataFrame:
    """(kind, norm_title, n_records, n_institutions, n_same) of titles that several institutions sent in."""
    t = rows.filter(text.present(title)).withColumn("norm_title", text.plain_title(title))
    return t.groupBy(kind, "norm_title").agg(F.count("*").alias("n_records"), F.countDistinct(institution).alias("n_institutions"), F.min(key).alias("first_id")).filter("n_institutions > 1")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a row number by an order without ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
