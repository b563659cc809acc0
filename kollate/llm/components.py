"""Consolidating pairwise matches into groups (problem 2).

Connected components on a two-dimensional grid. Vertices are hashed into ``side`` blocks; an edge
belongs to the cell of its two blocks. A round runs a union-find inside every cell and exchanges the
representatives: each vertex takes the first one it got from the cells of its row and of its column; as cells are kept for
either order of their blocks alike, both exchanges are one aggregation by vertex. Vertices
that represent nobody are then done, and what remains are edges between representatives. The rounds end
when no such edge is left; parents are then followed back down. There are two blocks at least, however few edges are left.

Representatives are chosen by a mixed order of the ids, not by the ids themselves, so that a chain of
rising ids also loses a fixed share of its vertices in every round. A hub with a third of all edges is
spread over the ``side`` cells of its row, so no cell grows with it; joins on a key or head that many rows have deal it out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kollate.operators.skew import spread_join
from kollate.session import cut, release

#: Edges a cell may hold on average, and of one hub's row.
CELL_EDGES = 500_000
MAX_ROUNDS = 60


def mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random order key of each id (the finaliser of splitmix64, a bijection)."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the given edges and, for each, the first vertex of its component in the mixed order."""
    ids = np.unique(np.concatenate([u, v]))
    order = np.argsort(mixed(ids), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    a, b = rank[np.searchsorted(ids, u)], rank[np.searchsorted(ids, v)]
    parent = np.arange(len(ids))
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return ids, ids[order[parent[rank]]]


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, root = union_find(pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64))
    moved = ids != root
    return pd.DataFrame({"node": ids[moved], "root": root[moved], "key": mixed(root[moved])})


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).filter("u < v").distinct()


def connected_groups(edges: DataFrame, left: str = "u", right: str = "v", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(node, group) for every vertex of ``edges`` tied to another one; group is the smallest vertex.

    Nulls on either side and self-loops tie nothing; repeated and reversed edges count once; an empty
    input gives an empty result; other columns are ignored, whatever their names.
    """
    rest = cut(_ordered(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna(), "a", "b"), "edges")
    parents: list[DataFrame] = []
    exchanged: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        n = rest.count()
        if not n:
            break
        side = max(2, math.ceil(math.sqrt(n / cell_edges)), math.ceil(n / (12 * cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        cells = rest.withColumn("bu", block("u")).withColumn("bv", block("v"))
        cells = cells.select("u", "v", F.least("bu", "bv").alias("row"), F.greatest("bu", "bv").alias("column"))
        local = cells.groupBy("row", "column").applyInPandas(_cell, "node long, root long, key long")
        local = cut(local, "local")
        parent = local.groupBy("node").agg(F.min(F.struct("key", "root"))["root"].alias("parent"))
        heads = local.select(F.col("root").alias("node")).distinct().withColumn("head", F.lit(True))
        parent = cut(parent.join(heads, "node", "left"), "exchange")
        parents.append(parent.filter("head is null").select("node", "parent"))
        between = local.join(parent, "node").select("root", "parent")
        kept = parent.filter("head").select(F.col("node").alias("root"), "parent")
        rest = cut(_ordered(between.unionByName(kept), "root", "parent"), "edges", rest, local)
        exchanged.append(parent)
    else:
        raise RuntimeError(f"representatives did not stabilise in {MAX_ROUNDS} rounds")
    if not parents:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("group"))
    final = parents[-1].withColumnRenamed("parent", "head")
    for parent in reversed(parents[:-1]):  # a parent of one round may have got a parent in a later one
        upper = final.select(F.col("node").alias("parent"), F.col("head").alias("up"))
        lower = spread_join(parent, upper, ["parent"], "left").select("node", F.coalesce("up", "parent").alias("head"))
        final = cut(lower.unionByName(final), "groups", *([final] if hasattr(final, "_cut") else []))
    if len(parents) > 1:
        release(*exchanged)
    smallest = final.groupBy("head").agg(F.least(F.min("node"), F.col("head")).alias("group"), F.count("*").alias("n"))
    members = spread_join(final, smallest.select("head", "group"), ["head"], counted=smallest.select("head", "n")).select("node", "group")
    return members.unionByName(smallest.select(F.col("head").alias("node"), "group"))


def star_edges(members: DataFrame, key: str, node: str) -> DataFrame:
    """Ties every node of a key to the key's smallest node: as many edges as members, never all pairs.

    Keys with one node are dropped before the join, so only real ties are shuffled a second time.
    """
    m = cut(members.select(F.col(key).alias("k"), F.col(node).alias("v")).dropna().distinct(), "members")
    rep = m.groupBy("k").agg(F.min("v").alias("u"), F.max("v").alias("top"), F.count("*").alias("n")).filter("u < top")
    return spread_join(m, rep.select("k", "u"), ["k"], counted=rep.select("k", "n")).filter("u < v").select("u", "v")


def normal_doi(column) -> F.Column:
    """A DOI without surrounding blanks, leading label or resolver address, in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(bare, r"^(?:https?://(?:dx\.)?doi\.org/|info:\s*doi/|urn:doi:|doi(?:\s*[:.=]\s*|\s+|/))+\s*", "")
    return F.when(F.length(bare) > 0, bare)


def work_edges(works: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(u, v) of works tied by a submission id, a well-formed DOI, or the latest verdict on their pair.

    Of verdicts with equal ``decided_at`` the one with the larger ``pair_id`` is the latest; an undated
    verdict is older than any dated one. Verdicts on works that ``works`` doesn't hold tie nothing.
    """
    ids = works.select("canonical_id", F.explode("source_ids").alias("key"))
    by_id = star_edges(ids, "key", "canonical_id")
    dois = works.filter("doi_wellformed").select("canonical_id", normal_doi(F.col("doi")).alias("key"))
    by_doi = star_edges(dois, "key", "canonical_id")
    pairs = verdicts.select(F.least("left_id", "right_id").alias("u"), F.greatest("left_id", "right_id").alias("v"), "verdict", "decided_at", "pair_id")
    latest = pairs.filter("u < v").groupBy("u", "v").agg(F.max(F.struct("decided_at", "pair_id", "verdict")).alias("last"))
    accepted = latest.filter("last.verdict = 'accepted'").select("u", "v")
    known = works.select("canonical_id").distinct()
    for side in ("u", "v"):
        accepted = accepted.join(known, F.col(side) == F.col("canonical_id"), "left_semi")
    return by_id.unionByName(by_doi).unionByName(accepted)


def work_groups(works: DataFrame, verdicts: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(canonical_id, group_id) of every work tied to at least one other."""
    found = connected_groups(work_edges(works, verdicts), cell_edges=cell_edges)
    return found.select(F.col("node").alias("canonical_id"), F.col("group").alias("group_id"))
