import random

import numpy as np
import pytest

from kollate.llm import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def random_edges(seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(200)]
    falling = [(1000 - i, 999 - i) for i in range(100)]
    hub = [(5000, 5000 + i) for i in range(1, 200)]
    loose = [(rng.randrange(6000, 7000), rng.randrange(6000, 7000)) for _ in range(400)]
    return chain + falling + hub + loose + chain[:20] + [(b, a) for a, b in hub[:20]] + [(7, 7), (None, 3), (3, None)]


@pytest.mark.parametrize("cell_edges", [10**6, 200, 40])
def test_grid_equals_union_find(spark, cell_edges):
    edges = random_edges(1)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "u long, v long, node string, label int")
    got = {tuple(r) for r in components.connected_groups(df, cell_edges=cell_edges).collect()}
    assert got == brute(edges)


def test_empty_and_self_loops(spark):
    df = spark.createDataFrame([(1, 1), (None, None)], "u long, v long")
    assert components.connected_groups(df).count() == 0
    assert components.connected_groups(df.limit(0)).count() == 0


def test_cell_union_find():
    ids, root = components.union_find(np.array([1, 2, 9, -5]), np.array([2, 3, 8, 9]))
    assert len(set(root[ids <= 3][ids[ids <= 3] > 0])) == 1 and len(set(root[(ids > 3) | (ids < 0)])) == 1


@pytest.mark.parametrize("raw,key", [(" DOI: 10.1/A ", "10.1/a"), ("info:doi/10.1/a", "10.1/a"), ("doi 10.1/a", "10.1/a"), ("https://doi.org/10.1/a", "10.1/a"), ("doi:", None), ("  ", None), (None, None)])
def test_doi_keys(spark, raw, key):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "d string").select(components.normal_doi(F.col("d")).alias("k")).head().k == key


def test_ties_of_works(spark):
    works = spark.createDataFrame([
        (1, [10, 11], "10.1/x", True), (2, [11], None, None), (3, [], "doi:10.1/X ", True), (4, None, "10.1/x", False), (5, [50], None, None),
        (6, [60], None, None), (7, [70], None, None), (8, [None], "10.1/q", None), (9, [None], None, None), (5, [50], None, None)], "canonical_id long, source_ids array<long>, doi string, doi_wellformed boolean")
    verdicts = spark.createDataFrame([
        (1, 5, 6, "accepted", "2014-01-01"), (2, 6, 5, "rejected", "2015-01-01"), (3, 6, 7, "rejected", "2014-01-01"), (4, 7, 6, "accepted", "2014-01-01"),
        (5, 8, 8, "accepted", "2014-01-01"), (6, 9, 99, "accepted", "2014-01-01"), (7, 8, 9, "accepted", None), (8, 9, 8, "pending", "2010-01-01")], "pair_id long, left_id long, right_id long, verdict string, d string")
    verdicts = verdicts.selectExpr("pair_id", "left_id", "right_id", "verdict", "cast(d as timestamp) decided_at")
    got = dict(map(tuple, components.work_groups(works, verdicts).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6}
