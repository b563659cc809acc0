"""Queries that must take in every row, against brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from kollate.functions.udfs import _jaro_winkler
from kollate.plans import linkage, sources
from kollate.plans.queries import QUERIES
from kollate.plans.registry import Tables


def keys(rows):
    return {k for r in rows if r[0] is not None and len(k := re.sub("[^a-z0-9]", "", r[0].lower())) >= 10}


def test_fuzzy_titles_from_090(spark):
    t = Tables(spark, SMALL)
    a, b = keys(linkage.works(t).select("title").collect()), keys(t.trove.select("trove_title").collect())
    expected = {(k, j) for k in a for j in b if k[:10] == j[:10] and _jaro_winkler(k, j) >= 0.9}
    got = {(r.k, r.j): r.similarity for r in QUERIES["fuzzy_titles"](spark, SMALL).collect()}
    assert set(got) == expected and min(got.values()) < 0.97


def brute_label(a, b, subtitle_first):
    """The title rules one by one; on texts without combining marks, which the engines class differently."""
    if not a or not b:
        return "omitted"
    if a == b:
        return "exact"
    signs, to = (r"[^\w\s]", "") if subtitle_first else (r"[^a-zA-Z0-9\s]", " ")
    p, q = (re.sub(r"\s+", " ", re.sub(signs, to, x)).strip().lower() for x in (a, b))
    x, y = a.strip(" ").lower(), b.strip(" ").lower()
    short, long_ = (x, y) if len(x) < len(y) else (y, x)
    cropped = x != y and any(long_.startswith(short + m) or long_.split(m.strip())[0].strip(" ") == short for m in (":", " -", " --", " —", " /"))
    rules = [("cropped_subtitle", cropped), ("punctuation_or_case", p == q)]
    for label, holds in rules if subtitle_first else rules[::-1]:
        if holds:
            return label
    s, l = (p, q) if len(p) < len(q) else (q, p)
    if len(l) == len(s) + 1 and any(l[:i] + l[i + 1 :] == s for i in range(len(l))):
        return "spelling_indel"
    u, v = set(p.split(" ")), set(q.split(" "))
    return "discordant" if p and q and len(u & v) / len(u | v) < 0.25 else "typographical_variant"


def marked(*texts):
    return any(unicodedata.category(c)[0] == "M" for x in texts for c in x or "")


def test_titles_of_all_alphabets_get_labels(spark):
    t = Tables(spark, SMALL)
    pairs = {r.row_id: (r.title, r.ititle, r.research_output_type) for r in linkage.deliveries(t).collect()}
    got = {r.row_id: r.label for r in QUERIES["delivery_title_labels"](spark, SMALL).collect()}
    assert set(got) == {r.row_id for r in t.works.collect()}
    wrong = {k: (a, b, got[k]) for k, (a, b, _) in pairs.items() if not marked(a, b) and got[k] != brute_label(a, b, True)}
    assert not wrong and any(not (a or "").isascii() for a, _, _ in pairs.values())
    typed = {}
    for k, (_, _, kind) in pairs.items():
        typed[kind, got[k]] = typed.get((kind, got[k]), 0) + 1
    assert {(r.kind, r.label): r.n for r in QUERIES["labels_by_type"](spark, SMALL).collect()} == {k: n for k, n in typed.items() if n >= 10}
    counts = {}
    for r in linkage.title_pairs(t).collect():
        label = brute_label(r.title, r.ititle, False)
        counts[label] = counts.get(label, 0) + 1
    assert {r.label: r.n for r in QUERIES["index_title_labels"](spark, SMALL).collect()} == counts


def test_all_titles_pass_through_xml(spark):
    rows = Tables(spark, SMALL).works.select("row_id", "title").filter("title IS NOT NULL").collect()
    got = {r.paper: r.title for r in QUERIES["parse_tei_headers"](spark, SMALL).collect()}
    assert got == {str(r.row_id): " ".join(r.title.split()) or None for r in rows}
    odd = spark.createDataFrame([(1, " R&D: <b>x</b> &amp; 5 > 3 "), (2, "Ünï  \u0001 名前 Ω-3 𝒳"), (3, "]]> a\tb")], "row_id long, title string")
    assert {r.paper: r.title for r in sources.tei_headers(odd).collect()} == {"1": "R&D: <b>x</b> &amp; 5 > 3", "2": "Ünï 名前 Ω-3 𝒳", "3": "]]> a b"}


def test_components_of_long_chains(spark):
    from kollate.operators import resolve

    ids = list(range(1500))
    random.Random(4).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(i, i + 1) for i in range(2000, 2999)]
    nodes, ties = spark.createDataFrame([(i,) for i in [*ids, *range(2000, 3001)]], "id long"), spark.createDataFrame(edges, "u long, v long")
    got = dict(map(tuple, resolve.components(nodes, "id", ties).collect()))
    assert got == {i: 0 for i in ids} | {i: 2000 for i in range(2000, 3000)} | {3000: 3000}
    with pytest.raises(RuntimeError):
        resolve.components(nodes, "id", ties, rounds=1)


def test_overlap_has_a_fuzzy_tier(spark):
    t = Tables(spark, SMALL)
    plain = lambda x, to: " ".join(re.sub(r"[^a-z0-9\s]", to, (x or "").lower()).split())
    key = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
    by_work = {}
    for r in t.trove.select("trove_work_id", "trove_title").collect():
        if r.trove_title is not None:
            by_work.setdefault(r.trove_work_id, set()).add(r.trove_title)
    firsts = {min(plain(x, " ") for x in v) for v in by_work.values()}
    whole = {key(x) for v in by_work.values() for x in v}
    found = {r.canonical_id: r.match_tier for r in linkage.catalogue_links(t).collect()}
    expected = {}
    for r in linkage.works(t).collect():
        a, k = plain(r.title, " "), key(r.title)
        tier = found.get(r.canonical_id)
        if tier is None and len(a) >= 15 and any(len(b) >= 15 and (a.startswith(b) or b.startswith(a)) for b in firsts):
            tier = "prefix"
        if tier is None and len(k) > 15 and any(len(j) > 15 and k[:10] == j[:10] and _jaro_winkler(k, j) >= 0.9 for j in whole):
            tier = "fuzzy"
        expected[tier or "none"] = expected.get(tier or "none", 0) + 1
    got = {r.tier: r.n for r in QUERIES["overlap_partition"](spark, SMALL).collect()}
    assert got == expected and got["fuzzy"] > 0
