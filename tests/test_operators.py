import itertools
import random

import pytest
from pyspark.sql import functions as F

from kollate.operators import disparity, link, references, resolve


def label(spark, a, b, subtitle_first=True, ua=None, ub=None):
    df = spark.createDataFrame([(a, b, ua or a, ub or b)], "a string, b string, ua string, ub string")
    return df.select(disparity.title(F.col("a"), F.col("b"), F.col("ua"), F.col("ub"), subtitle_first).alias("l")).head().l


@pytest.mark.parametrize("a,b,expected", [
    (None, "x", "omitted"), ("", "x", "omitted"), ("Same", "Same", "exact"),
    ("Learning", "Learning: a view", "cropped_subtitle"), ("Learning - now", "Learning", "cropped_subtitle"),
    ("A title, here", "a title here", "punctuation_or_case"), ("colour of sky", "color of sky", "spelling_indel"),
    ("one two three", "four five six seven", "discordant"), ("the big red house on hills", "the big blue house on hills", "typographical_variant"),
])
def test_title_labels(spark, a, b, expected):
    assert label(spark, a, b) == expected


def test_entities_come_before_all_else(spark):
    assert label(spark, "A &amp; B", "A & B", ua="A & B") == "markup_or_entity"


def test_order_of_rules_differs_between_sources(spark):
    a, b = "re-use: of", "re-use of"
    assert label(spark, a, b, True) == label(spark, a, b, False) == "punctuation_or_case"
    assert label(spark, "co-op", "coop", True) == "punctuation_or_case" and label(spark, "co-op", "coop", False) == "spelling_indel"


def test_one_sign_apart_is_brute_force(spark):
    words = ["".join(w) for n in range(4) for w in itertools.product("ab ", repeat=n)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", disparity.one_sign_apart(F.col("a"), F.col("b")).alias("o")).collect()
    for r in got:
        s, l = sorted((r.a, r.b), key=len)
        assert r.o == (len(l) == len(s) + 1 and any(l[:i] + l[i + 1 :] == s for i in range(len(l)))), (r.a, r.b)


def test_profiles(spark):
    rows = [(t, y, d) for t in (True, False) for y in (None, 0, 2) for d in (True, False)]
    got = {(r.t, r.y, r.d): (r.p, r.c) for r in spark.createDataFrame(rows, "t boolean, y int, d boolean").select("*", disparity.profile(F.col("t"), F.col("y"), F.col("d")).alias("p"), disparity.coupled(F.col("y"), F.col("d")).alias("c")).collect()}
    assert got[False, None, False] == ("clean", False) and got[True, 2, True] == ("coupled_with_title_disp", True)
    assert got[False, 2, True] == ("coupled_lifecycle_drift", True) and got[True, 2, False] == ("title_and_year_disp", False)
    assert got[True, 0, True] == ("title_and_doi_disp", False) and got[False, 0, True] == ("isolated_doi_disp", False)


def test_drift(spark):
    df = spark.sql("select array(named_struct('author_id', 1, 'affiliations', array('x')), named_struct('author_id', 2, 'affiliations', array('y'))) a, array(named_struct('author_id', 2, 'affiliations', array('y')), named_struct('author_id', 1, 'affiliations', array('z'))) b")
    got = df.select(disparity.authorship_drift(F.col("a"), F.col("b")).alias("d")).head().d
    assert (got.count_difference, got.reordered, got.affiliations_changed) == (0, True, True)


def test_tiers_fall_through(spark):
    left = spark.createDataFrame([(1, "d1", "t one"), (2, None, "t two"), (3, "d9", "t none"), (4, None, "twice")], "id long, d string, t string")
    right = spark.createDataFrame([("e1", "d1", "x"), ("e0", "d1", "t one"), ("e2", None, "t two"), ("e3", None, "twice"), ("e4", None, "twice")], "eid string, rd string, rt string")
    rank = F.when(F.col("t") == F.col("rt"), 1).otherwise(2)
    tiers = [link.Tier("doi", F.col("d"), F.col("rd"), order=[rank]), link.Tier("title", F.col("t"), F.col("rt"), unique=True)]
    got = {tuple(r) for r in link.link(left, right, "id", "eid", tiers).collect()}
    assert got == {(1, "e0", "doi"), (2, "e2", "title")}
    assert link.link(left.limit(0), right, "id", "eid", tiers).count() == 0


def test_fuzzy_bound_loses_nothing(spark):
    rng = random.Random(5)
    words = list({"abcd" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.w, r.v) for r in link.fuzzy_pairs(df, df.withColumnRenamed("w", "v"), "w", "v", 0.9, 4).collect()}
    from kollate.functions.udfs import _jaro_winkler

    assert got == {(a, b) for a in words for b in words if a[:4] == b[:4] and _jaro_winkler(a, b) >= 0.9}


def test_components_are_an_equivalence(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    nodes = spark.createDataFrame([(i,) for i in range(150)], "id long")
    got = dict(map(tuple, resolve.components(nodes, "id", spark.createDataFrame(edges, "u long, v long")).collect()))
    label = {i: i for i in range(150)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    assert got == label and len(got) == 150


ROWS = "id long, kind string, institution string, title string, doi string, doi_wellformed boolean, identifier string, identifier_wellformed boolean, reference_year int, outlet string"


def test_submission_groups(spark):
    rows = [
        (1, "A", "i", "two words", "10.1/a", True, None, False, 2014, "o"), (2, "A", "j", "Two Words ", None, False, None, False, 2015, "o"),
        (3, "A", "k", "other title", "10.1/A", True, None, False, 2014, "p"), (4, "B", "k", "clash here", "10.1/b", True, None, False, 2014, None),
        (5, "B", "k", "clash here", "10.1/c", True, None, False, 2014, None), (6, "B", "k", None, None, None, None, None, None, None), (7, "B", "k", "single", None, False, None, False, 2010, None), (8, "B", "k", "single", None, False, None, False, 2010, None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    groups = resolve.components(df, "id", resolve.submission_ties(df))
    assert dict(map(tuple, groups.collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    out = {r.canonical_id: r for r in resolve.canonical(df.join(groups, "id")).collect()}
    assert sum(len(r.source_ids) for r in out.values()) == len(rows)
    assert set(out[1].codes) == {"E", "T", "R"} and out[1].year_differs and out[1].n_submissions == 3


def test_repairs(spark):
    v = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefghij"), (3, "mnopqrst"), (4, "mnopqrstu"), (5, "mnopqrstv"), (6, None), (7, "short")], "id long, v string")
    got = {r.id: (r.repaired, r.cut) for r in resolve.repair_truncated(v, "v", "id", 8).collect()}
    assert got[1] == ("abcdefghij", "F") and got[3] == ("mnopqrst", "F") and got[6] == (None, None) and got[7] == ("short", None)
    t = spark.createDataFrame([(1, "d", "a titlehere"), (2, "d", "a title here"), (3, "e", "a titlehere"), (4, None, "x"), (5, "d", None)], "id long, g string, v string")
    got = {r.id: (r.repaired, r.indel) for r in resolve.repair_indels(t, "g", "v").collect()}
    assert got == {1: ("a title here", "K"), 2: ("a title here", None), 3: ("a titlehere", None), 4: ("x", None), 5: (None, None)}


def test_inversions(spark):
    def run(names):
        return references.inversions(spark.createDataFrame([("p", n, i) for i, n in enumerate(names, 1)], "p string, s string, i int"), "p", "s", "i").collect()

    assert run(["ADAMS", "BELL", "COOK", "DAVIS", "EVANS"]) == []
    (r,) = run(["BELL", "COOK", "DAVIS", "ADAMS", "EVANS"])
    assert (r.i, r.previous, r.previous_position, r.distance, r.major) == (4, "DAVIS", 3, 3, True)


def test_orphans_and_outliers(spark):
    titles = [("water flow models", 2001), ("urban water supply", 2003), ("river water rights", 2010), ("water and law", 2012), ("locomotive valves", 1985)]
    refs = spark.createDataFrame([("p", i, t, y, 2014) for i, (t, y) in enumerate(titles)], "p string, r int, t string, y int, c int")
    assert [r.t for r in references.orphans(refs, "p", "r", "t", "y", "c").collect()] == ["locomotive valves"]
    old = spark.createDataFrame([(1980, 2, "x"), (1859, 50000, "y"), (1970, None, None), (2010, 0, "z"), (None, 1, "q")], "y int, n int, t string")
    assert [r.o for r in old.select(references.obscure_old(F.col("y"), F.col("n"), F.col("t"), F.lit(2014)).alias("o")).collect()] == [True, False, True, False, False]


def test_compare_lists(spark):
    df = spark.createDataFrame([(["The shared title", "only on the left"], ["the shared  title", "only on the right"]), ([], [])], "a array<string>, b array<string>")
    got = [r.c for r in df.select(references.compare_lists(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0].jaccard == pytest.approx(1 / 3) and got[1].jaccard == 1.0


def test_copying_model(spark):
    cites = [(1, "typo", c) for c in (10, 11, 12)] + [(1, "once", 13)]
    s = references.spectrum(spark.createDataFrame(cites, "w long, t string, c long"), ["w", "t"], "c")
    r = references.copying(s).head()
    assert (r.n_variants, r.n_citations, r.rho) == (2, 4, 0.25)
    assert references.copying(s.limit(0)).head().rho is None
