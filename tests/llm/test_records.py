"""Matching, consensus and packing."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from kollate.llm import consensus, matching, packing


def test_consensus_prefers_what_is_last_and_trusted():
    c = lambda v, d, t: {"value": v, "delivered": d, "trust": t}
    assert consensus.survivor([c("a b c", 1, 1), c("a b d", 2, 5), c("a b c x", 0, 3)])["value"] == "a b d"
    assert consensus.survivor([c("a b", 9, 9), c("a b: more", 1, 1)])["value"] == "a b: more"
    # Nothing is best in both: the tokens decide.
    assert consensus.survivor([c("red house on hill", 3, 1), c("red house on hill top", 1, 2), c("blue hut", 2, 3)])["value"] == "red house on hill top"
    # Many rows that agree weigh more than one.
    assert consensus.survivor([c("red house", 2, 1) | {"rows": 50}, c("blue house", 1, 2)])["value"] == "red house"
    assert consensus.survivor([c("red house", 2, 1), c("blue house", 1, 2) | {"rows": 50}])["value"] == "blue house"
    columns = consensus.consensus([["a", "b", "c"], ["a", "x", "c"], ["a", "b", "z"]], [1, 1, 1], [False] * 3)
    assert consensus.decided(columns) == ["a", "b", "c"]


def test_what_is_first_in_both_ranks_outweighs_all_others():
    rng = random.Random(3)
    for n in (2, 3, 10, 200):
        values = [{"value": f"v{i}", "delivered": rng.randrange(n), "trust": rng.randrange(5), "rows": rng.choice([1, 1, 9])} for i in range(n)]
        values[0] |= {"delivered": n, "trust": 5, "rows": 1}
        assert consensus.survivor(values) is not None and consensus.survivor(values)["value"] == "v0"
        weights = consensus.decide(values)[1]
        assert weights[0] > sum(weights[1:])


def works(spark, rows):
    kind = "row_id long, canonical_id long, title string, doi string, doi_wellformed boolean, reference_year int, outlet string, delivered_by string, delivered_at timestamp, trust int"
    return spark.createDataFrame(rows, kind)


def test_surviving_values(spark):
    from datetime import datetime as at

    rows = [
        (1, 7, "Untitled", "n/a", False, 0, None, "A", at(2012, 1, 1), 1), (2, 7, "A whole title of a work", "10.1/x", True, 2010, " ", "B", at(2013, 1, 1), 1), (3, 7, "A whole title of a work", "10.1/y", True, 9999, "unknown", "C", at(2014, 1, 1), 1),
        (4, 8, "Alone", "10.1/z", True, 2010, "O", "A", None, 1), (5, 9, "Same", None, None, 2011, "O", None, None, 1), (6, 9, "Same", None, None, 2011, "O", "B", at(2012, 1, 1), 1), (7, None, "x", None, None, None, None, None, None, 1), (8, None, "x", None, None, None, None, None, None, 1)]
    institutions = spark.createDataFrame([("A", 1), ("B", 2), ("C", 5)], "institution string, trust_level int")
    got = {(r.canonical_id, r.field): r.row_id for r in consensus.best_values(works(spark, rows), institutions).collect()}
    assert got == {(7, "title"): 2, (7, "doi"): 3, (7, "reference_year"): 2, (9, "title"): 5, (9, "reference_year"): 5, (9, "outlet"): 5}
    assert consensus.best_values(works(spark, rows).limit(0), institutions).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 63, 64, 65, 300, 500])
def test_survivors_do_not_depend_on_where_a_group_is_decided(spark, n):
    rng = random.Random(n)
    places = ["hill", "hill top", "old hill top", "green hill", "valley"]
    texts = sorted({f"{rng.choice(['red', 'blue', 'grey'])} {rng.choice(['house', 'hut'])} {rng.choice('abcdefghij')} {i % 37} on the {rng.choice(places)}" for i in range(3 * n)})[:n]
    values = [{"value": t, "first": i, "delivered": rng.randrange(n), "trust": rng.randrange(1, 6), "rows": rng.choice([1, 1, 2, 30])} for i, t in enumerate(texts)]
    rows = [(1, "title", v["value"], v["first"], v["delivered"], v["trust"], v["rows"], size) for v in values for size in (n,)]
    df = spark.createDataFrame(rows, "work long, field string, value string, first long, delivered long, trust int, rows long, n long")
    whole = [tuple(r) for r in consensus.survivors(df, chunk=10**6).collect()]
    assert whole[0][2] == consensus.survivor(values)["value"]
    for chunk in (128, 200):
        assert [tuple(r) for r in consensus.survivors(df, chunk=chunk).collect()] == whole


def catalogue():
    rng = random.Random(2)
    adjectives, topics = ["rural", "urban", "coastal", "arid", "tropical", "alpine", "riparian", "endemic"], ["water quality", "soil salinity", "bridge fatigue", "oral history", "fire ecology", "gene expression", "trade disputes", "sports injury"]
    places = ["Nimvar", "Kosho", "Velmon", "Tornga", "Hatlim", "Zanmi"]
    titles = sorted({f"Modelling of {rng.choice(adjectives)} {rng.choice(topics)} and {rng.choice(topics)} in the {rng.choice(places)} District" for _ in range(300)})
    return titles


def test_matching(spark):
    titles = catalogue()
    w = [(i, i, t, 2010 + i % 5, "978-0-306-40615-7" if i == 0 else None) for i, t in enumerate(titles)] + [(9001, 9001, None, None, None), (9002, 9002, "", 2010, None), (9003, 9003, "x " * 20000, 2010, None)]
    t = [(f"w{i}", x + " / by A. Writer", str(2010 + i % 5), ["9780306406157"] if i == 0 else []) for i, x in enumerate(titles[:60])]
    t += [("far", titles[70] + " [electronic resource]", str(2010 + 70 % 5 + 6), []), ("review", "Review of: " + titles[71], "2011", []), ("volume", titles[72] + ". Volume 2", str(2010 + 72 % 5), []),
          ("slip", titles[73].replace("Modelling", "Modleling").upper(), f"c{2010 + 73 % 5}", None), ("none", None, None, None), ("longer", titles[74] + ": a reply to critics", str(2010 + 74 % 5), [])]
    works_ = spark.createDataFrame(w, "row_id long, canonical_id long, title string, reference_year int, isbn string")
    found = spark.createDataFrame(t, "trove_work_id string, trove_title string, trove_issued string, trove_isbns array<string>")
    got = {(r.canonical_id, r.trove_work_id): r.confidence for r in matching.matched(works_, found).collect()}
    assert {(i, f"w{i}") for i in range(60)} <= set(got) and (73, "slip") in got
    assert not {k for k in got if k[1] in ("far", "review", "volume", "none", "longer")}
    assert all(0 <= c <= 1 for c in got.values())
    assert matching.matched(works_.limit(0), found).count() == 0


def test_cut_titles(spark):
    titles = catalogue()
    sub = titles[200] + ": who decides, and what it is for"
    w = [(i, i, t, 2010, None) for i, t in enumerate(titles[:60])]
    # Inside a word of a plain title, shortly after the break, inside the main part, and between words.
    w += [(501, 501, titles[201][:-6], 2010, None), (502, 502, titles[200] + ": who deci", 2010, None), (503, 503, titles[215].split(" in the ")[0][:-4], 2010, None), (504, 504, titles[230].rsplit(" ", 2)[0], 2010, None)]
    # The whole subtitle left out is another work; a cut that may be of two titles is neither; a title known whole isn't one that was cut.
    w += [(505, 505, titles[245], 2010, None), (506, 506, "Comparison of glacial mora", 2010, None), (507, 507, "Surveys of nocturnal poll", 2010, None), (507, 507, "Surveys of nocturnal pollen in cities", 2010, None)]
    t = [(f"w{i}", x, "2010", []) for i, x in enumerate(titles[:60])]
    t += [("plain", titles[201], "2010", []), ("sub", sub, "2010", []), ("main", titles[215] + ": a reply to critics", "2010", []), ("words", titles[230], "2010", []), ("longer", titles[245] + ": a reply to critics", "2010", []),
          ("one", "Comparison of glacial moraines and valleys", "2010", []), ("two", "Comparison of glacial moratoria under law", "2010", []), ("other", "Surveys of nocturnal pollinators on islands", "2010", [])]
    works_ = spark.createDataFrame(w, "row_id long, canonical_id long, title string, reference_year int, isbn string")
    found = spark.createDataFrame(t, "trove_work_id string, trove_title string, trove_issued string, trove_isbns array<string>")
    got = {(r.canonical_id, r.trove_work_id) for r in matching.matched(works_, found).collect()}
    assert {(501, "plain"), (502, "sub"), (503, "main"), (504, "words")} <= got
    assert not {k for k in got if k[0] in (505, 506, 507)}


@pytest.mark.parametrize("kind", ["slip", "subtitle", "cut"])
def test_blocks_find_what_differs(spark, kind):
    """Each kind of difference alone, on made titles: at least nine of ten pairs share a block."""
    rng = random.Random(6)
    titles = [t + rng.choice(["", ": a case for shared stewardship", " since the reform"]) for t in catalogue()]
    works_, found = [], []
    for i, t in enumerate(titles):
        at = rng.randrange(4, len(t) - 4)
        if kind == "slip":
            works_.append(t)
            found.append(t[:at] + t[at + 1] + t[at] + t[at + 2 :])
        elif kind == "subtitle":
            works_.append(t.split(":")[0] + ": what the evidence of ten years shows")
            found.append(t.split(":")[0])
        else:
            works_.append(t[: max(20, at)])
            found.append(t)
    def side(rows, catalogue_):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, title string")
        return df.select("i", matching.plain_title(matching.F.col("title"), catalogue_).alias("plain"))
    a, b = side(works_, False), side(found, True)
    left, right = matching._titles(a, "left"), matching._titles(b, "right")
    plain = lambda df: {r.i: r.plain for r in df.collect()}
    by_hash = lambda df: {r.t: r.whole for r in df.select("t", "whole").collect()}
    l, r = by_hash(left), by_hash(right)
    met = {(l[x.l], r[x.r]) for x in matching.candidate_titles(left, right).distinct().collect()}
    bare = lambda df: {x.i: x.s for x in df.select("i", matching.squeezed(matching._bare("plain")).alias("s")).collect()}
    wa, wb = bare(a), bare(b)
    assert np.mean([(wa[i], wb[i]) in met for i in range(len(titles))]) >= 0.9 and plain(a)


def test_block_keys_are_upper_bits_and_tell_other_works_apart(spark):
    keys = matching.band_keys(["grazing rights on common land", "a"], *matching.WHOLE, 1)
    assert not (keys & ((1 << (64 - matching.KEY_BITS)) - 1)).any() and len(np.unique(keys)) == keys.size
    title = "grazing rights and herders in the alpine commons of southern europe"
    a = spark.createDataFrame([(title, False)], "plain string, coded boolean")
    for other, blocks in (title, True), (title + " part 2", False), ("review of " + title, False), (title + "\tvol. ii", False):
        b = spark.createDataFrame([(other, True)], "plain string, coded boolean").select(matching.plain_title(matching.F.col("plain"), True).alias("plain"), "coded")
        left, right = matching._titles(a, "left"), matching._titles(b, "right")
        assert (matching.candidate_titles(left, right).count() > 0) == blocks
        assert [r.coded for r in left.collect()] == [False] and [r.coded for r in right.collect()] == [True]


def test_block_keys_travel_packed():
    """Packed rows give back every key and title in less than the 16 bytes of a row halved, and meet as their keys do, hot ones as well."""
    rng = np.random.default_rng(4)
    keys = (rng.integers(0, 2**40, 200_000) << 24).astype(np.int64)
    titles = (5 << 33) + rng.integers(0, 40_000, len(keys))
    packed = matching.pack(keys, titles, 1, 7)
    assert sorted(packed["part"]) == list(range(7)) and packed["keys"].map(len).sum() + packed["titles"].map(len).sum() < 8 * len(keys)
    back = [matching.unpack(r) for r in packed.itertuples(index=False)]
    assert sorted((int(k), int(t)) for ks, ts in back for k, t in zip(ks, ts)) == sorted(zip((keys.view(np.uint64) >> np.uint64(24)).tolist(), titles.tolist()))
    # Keys of either end, of one side alone, and one key that all titles have.
    few = np.array([0, 3, 2**39, 2**40 - 1, 7, 7, 7]) << 24
    l = [(few.astype(np.int64), np.arange(7) + 100 * i) for i in range(30)]
    r = [(few[[0, 3, 4, 5]].astype(np.int64), np.arange(4) + 1000 + 100 * i) for i in range(4)]
    rows = pd.concat([matching.pack(k, t, side, 3) for side, many in ((1, l), (0, r)) for k, t in many]).sort_values(["part", "side"])
    got = list(matching.meet(iter([rows.iloc[:50], rows.iloc[50:]]), most=40, given=50))
    assert max(map(len, got)) <= 50 and got[0].dtypes.tolist() == [np.int64, np.int64]
    brute = sorted((a, b) for lk, lt in l for k, a in zip(lk, lt) for rk, rt in r for q, b in zip(rk, rt) if k == q)
    assert sorted(map(tuple, pd.concat(got).to_numpy().tolist())) == brute and len(brute) == 30 * 4 * (2 + 6)
    assert not list(matching.meet(iter([]))) and not list(matching.meet(iter([rows[rows["side"] == 1]])))


def test_shuffle_files_go_with_their_table(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    table = matching.cut(spark.range(20_000).groupBy((matching.F.col("id") % 999).alias("k")).count(), "grouped")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and table.count() == 999 and spark.conf.get(key) == kept


def test_parts_of_a_title_are_prefixes_of_its_whole(spark):
    titles = ["the water - its uses: a history. vol. 2", "soils? a survey; with maps", ". odd", "plain", "a. - b", "an end: ", "日本: 歴史 - 都市", "the"]
    got = matching._titles(spark.createDataFrame([(t,) for t in titles], "plain string"), "parts").collect()
    found = {(r.whole, r.whole[: r.main], r.whole[: r.head]) for r in got}
    assert found == {("water its uses a history vol 2", "water", "water"), ("soils a survey with maps", "soils", "soils a survey"), ("odd", "", "odd"), ("plain", "plain", "plain"), ("a b", "a", "a"),
                     ("end", "end", "end"), ("日本 歴史 都市", "日本", "日本"), ("the", "the", "the")}


def test_confidence_comes_from_isbns(spark):
    """Labels are shared and unshared ISBNs; without any, the prior decides."""
    titles = catalogue()
    rows = [(i, i, t, 2010, f"978{i:09d}7") for i, t in enumerate(titles[:80])]
    t = [(f"w{i}", x, "2010", [f"978{i:09d}7" if i % 4 else f"978{i + 500:09d}7"]) for i, x in enumerate(titles[:80])]
    works_ = spark.createDataFrame(rows, "row_id long, canonical_id long, title string, reference_year int, isbn string")
    found = spark.createDataFrame(t, "trove_work_id string, trove_title string, trove_issued string, trove_isbns array<string>")
    scored, report = matching.scored_pairs(works_, found)
    assert report["labelled"] >= 80 and report["brier"] < 0.25 and {r.confidence for r in scored.filter("d = 0").collect()} <= {r.confidence for r in scored.collect()}
    scored, report = matching.scored_pairs(works_.withColumn("isbn", matching.F.lit(None).cast("string")), found)
    assert report["labelled"] == 0 and scored.filter("d = 0 AND confidence < 0.9").count() == 0


def test_classifier_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.0]))))
    y = (rng.random(4000) < p).astype(float)
    w = matching.fit(x[:3000], y[:3000])
    score = np.column_stack([np.ones(1000), x[3000:]]) @ w
    assert ((score > 0) == (y[3000:] > 0)).mean() > 0.75
    steps, levels = matching.isotonic(score, y[3000:], np.ones(1000))
    assert (np.diff(steps) >= 0).all() and (np.diff(levels) >= -0.2).all()
    guess = levels[np.clip(np.searchsorted(steps, score, side="right") - 1, 0, None)]
    assert abs(guess.mean() - y[3000:].mean()) < 0.05


def check_packing(out, sizes, capacities):
    for name, capacity in capacities.items():
        rows = [r for r in out if r.budget_name == name]
        total = {}
        for r in rows:
            total.setdefault(r.doc_id, 0)
            total[r.doc_id] += r.n_tokens
        assert total == {k: s or 0 for k, s in sizes.items()}
        fill = {}
        for r in rows:
            if r.container != "none":
                fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert all(v <= capacity for v in fill.values())
        for k, s in sizes.items():
            assert len([r for r in rows if r.doc_id == k]) == max(1, -(-(s or 0) // capacity))


@pytest.mark.parametrize("shard", [4000, 50])
def test_packing(spark, shard):
    rng = random.Random(8)
    sizes = {i: rng.choice([rng.randrange(1, 60), rng.randrange(40, 100)]) for i in range(400)} | {1000: 0, 1001: None, 1002: 100, 1003: 999, 1004: 1}
    items = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id long, n_tokens long, bin string")
    budgets = spark.createDataFrame([("small", 100), ("big", 1000), ("void", 0)], "budget_name string, capacity_tokens int")
    out = packing.pack(items, budgets, shard=shard).collect()
    check_packing(out, sizes, {"small": 100, "big": 1000})
    used = {r.container for r in out if r.budget_name == "small"} - {"none"}
    least = -(-sum(v or 0 for v in sizes.values()) // 100)
    assert len(used) <= least * 1.06 + 2
    assert packing.pack(items.limit(0), budgets).count() == 0


def test_no_budget_gives_no_containers(spark):
    items = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long")
    assert packing.pack(items, spark.createDataFrame([("void", 0), ("null", None)], "budget_name string, capacity_tokens int")).count() == 0


def test_genetic_steps_keep_every_item():
    rng = random.Random(1)
    sizes = [rng.randrange(20, 70) for _ in range(120)]
    start = packing._start(sizes, 100, 5)
    best, fill = packing.evolve(sizes, 100, start, 30, 5)[0]
    assert sorted(i for b in best for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) == f <= 100 for b, f in zip(best, fill))
    assert len(best) <= len(start[0][0])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_generations_of_a_run_save_containers(seed):
    rng = random.Random(seed)
    sizes = [min(511, 20 + int(rng.expovariate(1 / 160))) for _ in range(packing.SHARD)]
    start = packing._start(sizes, 512, seed)
    best, fill = packing.evolve(sizes, 512, start, packing.GENERATIONS, seed)[0]
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and max(fill) <= 512
    assert len(best) < min(len(p[0]) for p in start)
