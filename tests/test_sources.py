import json

from pyspark.sql import functions as F

from kollate.sources import readers, sinks
from kollate.streaming import incremental

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A paper</title></titleStmt><idno type="DOI">10.1/p</idno><date when="2014-02-01"/></fileDesc></teiHeader>
<text><body><div><head>Methods</head><p>As <ref type="bibr" target="#b0">(1)</ref> and <ref type="bibr" target="#b0">(1)</ref></p></div></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title level="a">Cited work</title><author><persName><forename>Ann</forename><surname>Bell</surname></persName></author><idno type="DOI">10.1/c</idno></analytic><monogr><title level="j">Journal</title><imprint><date when="1999-01"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    files = spark.createDataFrame([("x/12.tei.xml", bytearray(TEI.encode())), ("x/bad.xml", bytearray(b"<no")), ("x/empty.xml", bytearray(b""))], "path string, content binary")
    papers, refs, mentions = readers.read_tei(files)
    assert [tuple(r) for r in papers.collect()] == [("12", "A paper", "10.1/p", "2014", 1)]
    (r,) = refs.collect()
    assert (r.bibl_id, r.ref_title, r.ref_authors, r.ref_year, r.ref_journal, r.ref_doi) == ("b0", "Cited work", "Ann Bell", "1999", "Journal", "10.1/c")
    assert [tuple(m) for m in mentions.collect()] == [("12", "b0", "Methods")] * 2


def test_submissions(spark, tmp_path):
    good = {"id": 1, "type": "Book", "attributes": {"title": "T", "reference-year": 2014, "other-details": {"isbn": "0-19-852663-6", "doi": "doi:10.1/A"}}}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    df = readers.read_submissions(spark, str(tmp_path))
    (r,) = df.collect()
    assert (r.id, r.title, r.reference_year, r.isbn) == (1, "T", 2014, "0-19-852663-6")
    assert readers.join_keys(df).head().doi_normalized == "10.1/a"


def test_cached_answers(spark):
    docs = json.dumps([{"eid": "e1", "dc:title": "T", "author_names": "A, B;C, D", "citedby_count": "7", "openaccess": "1"}])
    cache = spark.createDataFrame([("10.1/a", docs), ("10.1/b", "[]"), ("10.1/c", None)], "doi string, payload string")
    got = {r.doi_normalized: r for r in readers.index_rows(cache).collect()}
    assert got["10.1/a"].status == "ok" and got["10.1/a"].n_authors == 2 and got["10.1/a"].citedby_count == 7
    assert got["10.1/b"].status == got["10.1/c"].status == "not_found"
    works = json.dumps([{"name": "book", "work": [{"id": "w1", "title": "X"}, {"id": "w2"}]}])
    rows = readers.catalogue_candidates(spark.createDataFrame([(1, works), (2, "[]")], "era_id long, payload string")).collect()
    assert sorted((r.era_id, r.status, r.trove_work_id, r.trove_rank) for r in rows if r.status == "ok") == [(1, "ok", "w1", 0), (1, "ok", "w2", 1)]
    assert [r.era_id for r in rows if r.status == "not_found"] == [2]


def test_nested(spark):
    df = spark.sql("select array(named_struct('type','isbn','value','1'), named_struct('type','uri','value','x 10.1234/a'), named_struct('type','uri','value','10.1234/b')) i")
    got = df.select(readers.harvest_ids(F.col("i")).alias("h")).head().h
    assert (got.doi, got.isbn, got.issn) == ("10.1234/b", "1", None)
    items = readers.portfolio_items(spark.createDataFrame([(1, '[{"title":" a "},{"title":""},{"title":null}]'), (2, None)], "id long, p string"), "id", "p")
    assert [tuple(r) for r in items.collect()] == [(1, 0, "a")]
    c = readers.citation_counts(spark.createDataFrame([('{"uid":"u","title":"t","citations":[{"db":"X","count":1},{"db":"WOS","count":5}]}',), ("nonsense",)], "p string"), "p")
    assert [tuple(r) for r in c.collect()] == [("u", "t", 5)]
    works = spark.sql("""select 'https://i/W7' id, array(named_struct('author_position','first','author',named_struct('id','A1','display_name','N','orcid',cast(null as string)),'institutions',array(named_struct('id','I9','display_name','U','country_code','AU'))),
      named_struct('author_position','last','author',named_struct('id','A2','display_name','M','orcid','o'),'institutions',cast(array() as array<struct<id:string,display_name:string,country_code:string>>))) authorships,
      array(named_struct('is_oa',true,'pdf_url','p','landing_page_url',cast(null as string),'version','v','source',named_struct('display_name','s','type','t')), named_struct('is_oa',true,'pdf_url',cast(null as string),'landing_page_url',cast(null as string),'version','v','source',named_struct('display_name','s','type','t'))) locations""")
    assert [(r.work, r.author_rank, r.n_institutions) for r in readers.authorships(works).collect()] == [(7, 1, 1), (7, 2, 0)]
    assert [(r.author_rank, r.institution_rank, r.institution_id) for r in readers.author_institutions(works).collect()] == [(1, 1, 9)]
    assert readers.locations(works, spark.createDataFrame([(7,)], "id long")).count() == 1
    assert readers.locations(works, spark.createDataFrame([(8,)], "id long")).count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int")
    assert sinks.markdown(df, "T", "note") == "## T\n\n| k | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |\n\nnote\n"
    sinks.write_report(df, str(tmp_path / "r"))
    assert (tmp_path / "r.csv").read_text().startswith("k,n\n")
    sinks.write_table(df, str(tmp_path / "t"))
    assert readers.read_many(spark, str(tmp_path / "t")).count() == 2


def test_streams(spark, tmp_path):
    for d in ("in", "out", "cp"):
        (tmp_path / d).mkdir()
    (tmp_path / "in/1.json").write_text('{"id": 1}\n{"id": 2}\n{"id": 1}\n')

    def run():
        incremental.append_once(incremental.new_lines(spark, str(tmp_path / "in"), "id long"), "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2]
    (tmp_path / "in/2.json").write_text('{"id": 2}\n{"id": 3}\n')
    assert run() == [1, 2, 3]
    todo = incremental.pending(spark.range(5), spark.createDataFrame([(1,), (1,)], "id long"), "id")
    assert sorted(r.id for r in todo.collect()) == [0, 2, 3, 4]
