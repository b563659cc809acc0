"""Matches of single submissions rolled up to works, and flags of all sources per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rank of a match's tier; others come last.
TIERS = {"doi": 1, "title": 2}
#: Rank of a lookup's status.
STATUSES = {"ok": 1, "not_found": 2}


def rank(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(max(ranks.values()) + 1)
    for name, place in ranks.items():
        out = F.when(F.col(column) == name, place).otherwise(out)
    return out


def ranked_union(sources: list[DataFrame]) -> DataFrame:
    """All rows of several tables of the same columns, with ``src_rank`` from 1 on in their order."""
    out = None
    for place, df in enumerate(sources, 1):
        rows = df.withColumn("src_rank", F.lit(place))
        out = rows if out is None else out.unionByName(rows)
    return out


def best_of(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """One row per key, the first in the order: an aggregate with partial steps."""
    rest = [c for c in rows.columns if c != by]
    picked = rows.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("b"))
    return picked.select(by, "b.*")


def matches_of_works(works: DataFrame, matches: list[DataFrame], target: str) -> DataFrame:
    """(canonical_id, target, match_tier, matched): each work with the best match of any of its submissions.

    ``works``: canonical_id, source_ids; ``matches``: tables of id, target, match_type, the preferred one first. A match by DOI goes before
    one by title, then comes the table's place, then the smallest target. Works without a match have nulls and ``matched`` false.
    """
    ids = works.select("canonical_id", F.explode(F.array_distinct("source_ids")).alias("id"))
    found = ids.join(ranked_union(matches).filter(F.col(target).isNotNull()), "id").drop("id")
    best = best_of(found, "canonical_id", rank("match_type", TIERS), F.col("src_rank"), F.col(target)).select("canonical_id", target, F.col("match_type").alias("match_tier"))
    joined = works.select("canonical_id").distinct().join(best, "canonical_id", "left")
    return joined.withColumn("matched", F.col(target).isNotNull())


def preferred_status(rows: DataFrame, key: str, status: str, tie: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """One row per key: the one with the best status; of equal ones the smallest ``tie``."""
    return best_of(rows.filter(F.col(key).isNotNull()), key, rank(status, ranks or STATUSES), F.col(tie))
