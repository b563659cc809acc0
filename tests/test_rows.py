"""Processed rows, rules by id, rollups and audits on small tables."""

from pyspark.sql import functions as F

from kollate.functions import text
from kollate.operators import clean, disparity, records, references, rollup

KIND = "id long, research_output_type string, title string, doi string, isbn string, outlet string, reference_year int"


def test_processed_rows(spark):
    rows = spark.createDataFrame([
        (1, "Book", " A <i>title</i>, 1914–1918. ", "doi:10.1234/X ", "978-0-306-40615-7", "Press.", 2010), (2, None, None, None, None, None, None), (3, "Book", "", " ", "n/a", "unknown", 2011), (3, "Book", "", " ", "n/a", "unknown", 2011)], KIND)
    got = records.processed(rows, ["isbn", "outlet"]).collect()
    first, none, blank = (next(r for r in got if r.id == k) for k in (1, 2, 3))
    assert (first.doi, first.doi_wellformed, first.doi_provenance) == ("10.1234/x", True, ["S", "K"]) and first.title_has_html and first.title_daterange_status == "adjusted"
    assert first.isbn_wellformed is True and first.outlet == "press" and first.outlet_provenance == ["R"]
    assert {r.doi_presence for r in (none, blank)} == {"missing"} and none.title is None and none.title_has_html is None and none.title_provenance == []
    assert (blank.isbn_presence, blank.isbn, blank.outlet_presence) == ("missing", None, "missing") and len(got) == 4
    assert records.processed(rows.limit(0), ["isbn", "outlet"]).count() == 0


def test_matches_once_both_sides_are_clean(spark):
    rows = spark.createDataFrame([("doi:10.1234/a", "10.1234/A"), ("10.1234/a", "10.1234/b"), (None, "10.1234/b"), (None, None)], "a string, b string")
    got = [r.m for r in rows.select(records.classify_match(F.col("a"), F.col("b"), clean.DOI).alias("m")).collect()]
    assert [m.wellformed for m in got] == [True, False, False, False] and got[0].value == "10.1234/a" and got[0].codes == ["S"] and got[1].codes == []


def test_rules_by_id(spark):
    rows = spark.createDataFrame([("Journal  of X", "1"), ("Other", "1"), ("Any", None), ("Any", "9"), (None, "1"), ("Any", "2")], "name string, key string")
    titles = spark.createDataFrame([("1", "journal of x"), ("2", "")], "id string, title string")
    got = {(r["name"], r["key"]): r.c and r.c.wellformed for r in records.listed_title(rows, "name", "key", titles, "c").collect()}
    assert got == {("Journal  of X", "1"): True, ("Other", "1"): False, ("Any", None): None, ("Any", "9"): None, (None, "1"): None, ("Any", "2"): None}
    agreed = clean.consensus_vocabulary(spark.createDataFrame([("Conf. of A", "1"), ("Conf. of A", "1"), ("Conf B", "1")], "name string, key string"), "key", "name")
    got = {r["name"]: r.c and r.c.wellformed for r in records.agreed_name(spark.createDataFrame([("CONF. of  A.", "1"), ("Conf B", "1"), ("Conf C", "7"), (None, "1")], "name string, key string"), "name", "key", agreed, "c").collect()}
    assert got == {"CONF. of  A.": True, "Conf B": False, "Conf C": True, None: None}


def test_rollup_prefers_tier_then_table_then_id(spark):
    works = spark.createDataFrame([(1, [10, 11, 11]), (2, [20]), (3, None), (4, [40])], "canonical_id long, source_ids array<long>")
    main = spark.createDataFrame([(10, "B", "title"), (11, "C", "doi"), (20, "Z", "title"), (40, None, "doi")], "id long, t string, match_type string")
    more = spark.createDataFrame([(11, "A", "doi"), (20, "Y", "title"), (20, "X", "other")], "id long, t string, match_type string")
    got = {r.canonical_id: (r.t, r.match_tier, r.matched) for r in rollup.matches_of_works(works, [main, more], "t").collect()}
    assert got == {1: ("C", "doi", True), 2: ("Z", "title", True), 3: (None, None, False), 4: (None, None, False)}
    found = rollup.preferred_status(spark.createDataFrame([("i", "not_found", "a"), ("i", "ok", "c"), ("i", "ok", "b"), (None, "ok", "d")], "k string, s string, t string"), "k", "s", "t")
    assert [tuple(r) for r in found.select("k", "s", "t").collect()] == [("i", "ok", "b")]


def test_audits(spark):
    edges = spark.createDataFrame([(1, 2000, 2006, 1), (1, 2000, 2001, 9), (1, 2000, 1890, 5), (2, 2000, 1975, 5), (2, 2000, 1975, None), (3, 2000, None, 0), (4, 2000, 1990, 0)], "citer long, citing_year int, cited_year int, cites int")
    assert references.audit_references(edges).head().asDict() == {"total_refs": 6, "anachronisms": 2, "severe_anachronisms": 1, "obscure_20y": 2, "obscure_30y": 1, "obscure_50y": 1, "obscure_100y": 1, "recent_refs": 1, "historical_refs": 3}
    assert references.audit_papers(edges).head().asDict() == {"total_papers": 3, "papers_with_anachronisms": 1, "papers_with_severe_anachronisms": 1, "papers_with_obscure_20y": 2, "papers_with_obscure_30y": 1, "papers_with_obscure_50y": 1, "papers_with_obscure_100y": 1}
    assert references.audit_references(edges.limit(0)).head().total_refs == 0


def test_accuracy(spark):
    rows = spark.createDataFrame([("A title", "A title", 2000, 2000, 1, True), ("A title", "a title.", 2000, 2001, 5, False), ("A title", None, None, 2001, None, None)], "cited_title string, ref_title string, cited_year int, ref_year int, mention_count long, in_methods boolean")
    rows = rows.withColumns({c: F.lit(None).cast("boolean") for c in ("in_results", "in_discuss", "in_intro")})
    judged = {r.ref_title: r for r in references.judged(rows).collect()}
    assert judged["A title"].section_group == "Methods/Data/Materials" and judged[None].importance_tier == "0 (Uncited in body)" and judged[None].title_type == "Type 3 (Severe Inaccuracy)"
    one = references.accuracy(references.judged(rows)).head()
    assert (one.total_citations, one.pct_exact_title, one.pct_year_disparity, one.mean_mentions) == (3, 33.33, 33.33, 2.0)


def test_reference_items(spark):
    lists = spark.createDataFrame([("p", [("7", "t", "1999", None), (None, "u", "n.d.", "10.1/x"), ("x", None, "20a", None)]), ("q", []), ("r", None)], "paper string, items array<struct<position:string,title:string,year:string,doi:string>>")
    assert [tuple(r) for r in references.reference_items(lists, "paper", "items").collect()] == [("p", 7, "t", 1999, None), ("p", 2, "u", None, "10.1/x"), ("p", 3, None, None, None)]


def test_one_sign_apart_of_long_texts(spark):
    long_ = "ab" * 20_000
    rows = spark.createDataFrame([(long_, long_ + "x"), (long_, long_[:100] + "x" + long_[100:]), ("abc", "abd"), ("", "a"), ("ab", "ba"), ("abc", "axbyc"), (None, "a")], "a string, b string")
    assert [r.x for r in rows.select(disparity.one_sign_apart(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, True, False, False, None]


def test_address_tiers(spark):
    rows = spark.createDataFrame([("https://arxiv.org/x",), ("https://eprints.QUT.edu.au/1",), ("https://zenodo.org/1",), ("https://example.org",), (None,)], "u string")
    assert [r.t for r in rows.select(text.address_tier("u").alias("t")).collect()] == [0, 1, 2, 3, 3]
