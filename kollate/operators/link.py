"""Tiered linkage: each tier sees what the ones before left over; each record keeps its best candidate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kollate.functions.udfs import jaro_winkler
from kollate.session import cut


@dataclass(frozen=True)
class Tier:
    """One way to pair records.

    ``left`` and ``right`` are the join keys; null keys pair with nothing. ``unique`` keeps only right keys
    that one record alone has. ``extra`` is a further condition on the pair, ``order`` ranks candidates.
    """

    name: str
    left: Column
    right: Column
    unique: bool = False
    extra: Callable[[], Column] | None = None
    order: list[Column] = field(default_factory=list)


def best(candidates: DataFrame, by: str, *order: Column) -> DataFrame:
    """One row per key: the first in the order. An aggregate with partial steps, so a hot key is no hot task."""
    rest = [c for c in candidates.columns if c != by]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = candidates.groupBy(by).agg(F.min_by(F.struct(*rest), key).alias("b"))
    return picked.select(by, *[F.col(f"b.{c}").alias(c) for c in rest])


def link(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[Tier]) -> DataFrame:
    """(left_id, right_id, match_tier): every record of ``left`` that a tier pairs, with its best candidate.

    What a tier found is written to the shared folder where another tier or the union needs it again."""
    done, rest = None, left
    for tier in tiers:
        r = right.withColumn("_k", tier.right).filter("_k is not null")
        if tier.unique:
            # One representative per key, and only keys of a single record.
            others = [c for c in right.columns]
            r = r.groupBy("_k").agg(F.min_by(F.struct(*others), F.col(right_id)).alias("_r"), F.min(right_id).alias("_a"), F.max(right_id).alias("_b")).filter("_a = _b").select("_k", "_r.*")
        l = rest.withColumn("_j", tier.left).filter("_j is not null")
        pairs = l.join(r, F.col("_j") == F.col("_k"))
        if tier.extra:
            pairs = pairs.filter(tier.extra())
        found = pairs.select(left_id, right_id, *[o.alias(f"_o{i}") for i, o in enumerate(tier.order)])
        found = best(found, left_id, *[F.col(f"_o{i}") for i in range(len(tier.order))], F.col(right_id)).select(left_id, right_id, F.lit(tier.name).alias("match_tier"))
        if len(tiers) > 1:
            found = cut(found, "tier")
        done = found if done is None else done.unionByName(found)
        if tier is not tiers[-1]:
            rest = rest.join(found.select(left_id), left_id, "left_anti")
    return done


def prefix_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int = 15) -> DataFrame:
    """Pairs where one text begins with the other, blocked by the first ``n`` signs."""
    a, b = left.withColumn("_p", F.left(F.col(left_key), F.lit(n))), right.withColumn("_p", F.left(F.col(right_key), F.lit(n)))
    joined = a.filter(F.length(left_key) >= n).join(b.filter(F.length(right_key) >= n), "_p").drop("_p")
    return joined.filter(F.startswith(F.col(left_key), F.col(right_key)) | F.startswith(F.col(right_key), F.col(left_key)))


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.9, n: int = 10) -> DataFrame:
    """Pairs of texts with a common start of ``n`` signs and a Jaro-Winkler similarity of ``least``.

    Similarities are computed once for each pair of different texts, however many rows share them. With
    a common start of four signs the similarity is 0.4 + 0.6 jaro, and jaro is at most
    (2 + shorter/longer)/3, so texts too different in length are left out unseen. Signs in common bound it as well: jaro
    is at most (m/n + m/l + 1)/3, where m counts the signs both have in any order; each text's signs are counted once.
    """
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    counts = lambda c: F.array(*[F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))) for x in signs], F.length(F.translate(F.col(c), signs, "")))
    a = left.select(F.col(left_key).alias("_a")).distinct().withColumn("_p", F.left(F.col("_a"), F.lit(n))).withColumn("_ca", counts("_a"))
    b = right.select(F.col(right_key).alias("_b")).distinct().withColumn("_p", F.left(F.col("_b"), F.lit(n))).withColumn("_cb", counts("_b"))
    pairs = a.join(b, "_p").drop("_p")
    if n >= 4:
        bound = 3 * (least - 0.4) / 0.6 - 2
        pairs = pairs.filter(F.least(F.length("_a"), F.length("_b")) >= bound * F.greatest(F.length("_a"), F.length("_b")) - 1e-6)
        common = F.aggregate(F.zip_with("_ca", "_cb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        jaro = (common / F.length("_a") + common / F.length("_b") + 1) / 3
        pairs = pairs.filter(0.4 + 0.6 * jaro >= least - 1e-9)
    pairs = pairs.select("_a", "_b")
    scored = pairs.withColumn("similarity", jaro_winkler("_a", "_b")).filter(F.col("similarity") >= least)
    return left.join(scored, left[left_key] == F.col("_a")).join(right, F.col("_b") == right[right_key]).drop("_a", "_b")


def priority_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first table and those of the second whose key the first doesn't have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def contained(texts: DataFrame, titles: DataFrame, text_id: str, text_: str, title_id: str, title: str, words: int = 4) -> DataFrame:
    """(text_id, title_id): of each text the longest title it holds; of equally long ones the smallest id.

    A title meets only texts that hold its first ``words`` words in a row, by a join of hashes, and is then
    looked for whole. Titles with fewer words are not looked for. Both sides must be plain words, one blank
    between; no text meets all titles.
    """
    def split(df, column):  # the words are taken apart once, not in every use
        return df.select("*", F.inline(F.array(F.struct(F.split(column, " ").alias("_w"))))).filter(F.size("_w") >= words)

    anchor = lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(words)])
    t = split(titles.select(F.col(title_id).alias("_i"), F.col(title).alias("_t")), "_t").select("_i", "_t", anchor(F.lit(0)).alias("_h"))
    x = texts.select(F.col(text_id).alias("_d"), F.col(text_).alias("_x"))
    windows = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_w") - words), anchor))
    anchors = split(x, "_x").select("_d", F.explode(windows).alias("_h"))
    hits = anchors.join(t, "_h").join(x, "_d").filter(F.contains(F.col("_x"), F.col("_t")))
    return best(hits.select("_d", "_i", F.length("_t").alias("_n")), "_d", -F.col("_n"), F.col("_i")).select(F.col("_d").alias(text_id), F.col("_i").alias(title_id))


def first_wins(rows: DataFrame, names: list[tuple[str, str]], key: str) -> DataFrame:
    """(name, key): each name of several sources in their order; a name two keys share goes to the earlier source, then the smaller key."""
    listed = F.array(*[F.struct(F.lit(i).alias("o"), F.expr(expr).alias("name")) for i, (_, expr) in enumerate(names)])
    flat = rows.select(F.col(key).alias("k"), F.inline(listed)).filter("name is not null and name <> ''")
    return flat.groupBy("name").agg(F.min(F.struct("o", "k"))["k"].alias(key))
