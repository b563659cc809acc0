"""Parsers of nested answers, XML and lists, fed with payloads made of the tables, and the remaining diagnostics."""

from pyspark.sql import functions as F

from kollate.functions import text
from kollate.operators import clean, disparity, link, references, resolve
from kollate.plans.linkage import ascii_titles, catalogue_links, deliveries, index_links, works
from kollate.plans.linkage import _LINK, _TROVE, label_sql
from kollate.plans.registry import query
from kollate.session import shared_dir
from kollate.sources import readers
from kollate.streaming import incremental

W = "era_research_outputs_canonical"


@query("SELECT DISTINCT lower(trim(doi_normalized)) AS doi_normalized, 'ok' AS status, title, n_authors, citedby_count, openaccess_flag, eid, affiliation_country FROM scopus_shard WHERE status = 'ok' AND doi_normalized IS NOT NULL AND eid IS NOT NULL")
def parse_index_answers(t):
    rows = t.index.filter("status = 'ok' AND doi_normalized IS NOT NULL AND eid IS NOT NULL")
    doc = F.struct(F.col("title").alias("dc:title"), "eid", F.array_join("author_names", ";").alias("author_names"), F.array_join("author_auids", ";").alias("author_ids"), F.col("citedby_count").cast("string").alias("citedby_count"), F.when(F.col("openaccess_flag"), "1").when(~F.col("openaccess_flag"), "0").alias("openaccess"), F.col("affiliation_country"))
    cache = rows.select(F.col("doi_normalized").alias("doi"), F.to_json(F.array(doc)).alias("payload"))
    return readers.index_rows(cache).select("doi_normalized", "status", "title", "n_authors", "citedby_count", "openaccess_flag", "eid", "affiliation_country").distinct()


@query("SELECT era_id, trove_category, trove_work_id, trove_title, trove_issued FROM trove_title_candidates WHERE era_id IS NOT NULL AND trove_work_id IS NOT NULL")
def parse_catalogue_answers(t):
    rows = t.trove.filter("era_id IS NOT NULL AND trove_work_id IS NOT NULL")
    work = F.struct(F.col("trove_work_id").alias("id"), F.col("trove_title").alias("title"), F.col("trove_issued").alias("issued"))
    cache = rows.select("era_id", F.to_json(F.array(F.struct(F.col("trove_category").alias("name"), F.array(work).alias("work")))).alias("payload"))
    return readers.catalogue_candidates(cache).filter("status = 'ok'").select("era_id", "trove_category", "trove_work_id", "trove_title", "trove_issued")


@query("SELECT eid, unnest(range(1, len(author_names) + 1)) AS author_rank, unnest(author_names) AS author_name FROM (SELECT eid, min(author_names) AS author_names FROM scopus_shard WHERE eid IS NOT NULL GROUP BY 1) WHERE author_names IS NOT NULL")
def flatten_authors(t):
    """Nested authorships made of the index lists, opened with their ranks."""
    one = t.index.filter("eid IS NOT NULL").groupBy("eid").agg(F.min("author_names").alias("names"))
    nested = one.select("eid", F.col("eid").alias("id"), F.transform("names", lambda n: F.struct(F.lit(None).cast("string").alias("author_position"), F.struct(F.lit("A1").alias("id"), n.alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), F.array(F.struct(F.lit("I1").alias("id"), F.lit("x").alias("display_name"), F.lit("AU").alias("country_code"))).alias("institutions"))).alias("authorships"))
    numbered = nested.withColumn("id", F.abs(F.xxhash64("eid")).cast("string"))
    flat = readers.authorships(numbered)
    return numbered.select("eid", text.digits_id("id").alias("work")).join(flat, "work").select("eid", F.col("author_rank").cast("long").alias("author_rank"), "author_name")


@query(f"SELECT CAST(row_id AS VARCHAR) AS paper, title FROM {W} WHERE regexp_full_match(title, '[A-Za-z ]+') AND NOT regexp_matches(title, '  |^ | $')")
def parse_tei_headers_plain(t):
    return tei_headers(t.works.filter(F.col("title").rlike("^[A-Za-z ]+$") & ~F.col("title").rlike("  |^ | $")))


@query()
def parse_tei_headers(t):
    """All titles, read again from XML: white space is one blank, none at the ends."""
    return tei_headers(t.works.filter("title IS NOT NULL"))


def tei_headers(rows):
    title = F.regexp_replace("title", r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")  # signs that XML can't hold
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(sign), F.lit(name))
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>'), title, F.lit("</title></teiHeader></TEI>"))
    papers, _, _ = readers.read_tei(rows.select(F.concat(F.lit("f/"), F.col("row_id").cast("string"), F.lit(".tei.xml")).alias("path"), F.to_binary(xml, F.lit("utf-8")).alias("content")))
    return papers.select("paper", "title")


@query(f"SELECT row_id, i - 1 AS item_index, trim(part, ' ') AS title FROM (SELECT row_id, unnest(range(1, len(string_split(title, ':')) + 1)) AS i, unnest(string_split(title, ':')) AS part FROM {W} WHERE title IS NOT NULL) WHERE trim(part, ' ') <> ''")
def parse_portfolio_items(t):
    rows = t.works.filter("title IS NOT NULL").select("row_id", F.to_json(F.transform(F.split("title", ":"), lambda p: F.struct(p.alias("title")))).alias("payload"))
    return readers.portfolio_items(rows, "row_id", "payload").select("row_id", F.col("item_index").cast("long").alias("item_index"), "title")


@query("SELECT DISTINCT id, title, doi, isbn FROM era_research_outputs_raw")
def parse_submission_lines(t):
    """Nested lines made of the submissions and flattened again."""
    nested = t.raw.select(F.to_json(F.struct("id", F.struct("title", F.struct("isbn", "doi").alias("other-details")).alias("attributes"))).alias("line"))
    parsed = nested.select(F.from_json("line", "struct<id: bigint, attributes: struct<title: string, `other-details`: struct<isbn: string, doi: string>>>").alias("r"))
    return parsed.select("r.id", "r.attributes.title", F.col("r.attributes.`other-details`.doi").alias("doi"), F.col("r.attributes.`other-details`.isbn").alias("isbn")).distinct()


_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_PLAIN.format('text')} AS x FROM documents), w AS (SELECT DISTINCT {_PLAIN.format('outlet')} AS y FROM {W} WHERE outlet IS NOT NULL), v AS (SELECT y FROM w WHERE len(string_split(y, ' ')) >= 3)
SELECT doc_id, first(y ORDER BY length(y) DESC, y) AS title FROM d JOIN v ON contains(x, y) WHERE len(string_split(x, ' ')) >= 3 AND contains(' ' || x, ' ' || split_part(y, ' ', 1) || ' ' || split_part(y, ' ', 2) || ' ' || split_part(y, ' ', 3)) GROUP BY 1""")
def titles_in_texts(t):
    """The longest outlet title that each document holds."""
    x = t.documents.select("doc_id", text.title_words("text").alias("x"))
    y = t.works.select(text.title_words("outlet").alias("y")).dropna().distinct().withColumn("title", F.col("y"))
    return link.contained(x, y, "doc_id", "x", "title", "y", 3)


@query("SELECT lower(institution_name) AS name, min(institution) AS institution FROM era_institutions GROUP BY 1 UNION SELECT lower(institution), min(institution) FROM era_institutions GROUP BY 1")
def institution_names_first(t):
    return link.first_wins(t.era_institutions, [("name", "lower(institution_name)"), ("code", "lower(institution)")], "institution")


@query(f"SELECT canonical_id, list_sort(list_distinct(flatten(list(title_provenance)))) AS codes, bool_and(coalesce(doi_wellformed, FALSE)) AS all_good, bool_or(coalesce(doi_wellformed, FALSE)) AS any_good FROM (SELECT * FROM {W} WHERE title_provenance IS NOT NULL) GROUP BY 1")
def codes_of_works(t):
    good = F.coalesce("doi_wellformed", F.lit(False))
    opened = t.works.filter("title_provenance IS NOT NULL").groupBy("canonical_id").agg(F.bool_and(good).alias("all_good"), F.bool_or(good).alias("any_good"))
    codes = t.works.select("canonical_id", F.explode("title_provenance").alias("c")).groupBy("canonical_id").agg(F.array_sort(F.collect_set("c")).alias("codes"))
    return opened.join(codes, "canonical_id", "left").select("canonical_id", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), "all_good", "any_good")


@query("SELECT doc_id, nullif(regexp_extract(text, 'https?://(?:www\\.)?([^/: ]+)', 1), '') AS host, nullif(regexp_extract(text, '10\\.[0-9]{4,9}/[A-Za-z0-9.]+', 0), '') AS doi FROM documents WHERE text IS NOT NULL")
def addresses_in_texts(t):
    d = t.documents.filter("text IS NOT NULL")
    return d.select("doc_id", text.null_if_blank(F.regexp_extract("text", r"https?://(?:www\.)?([^/: ]+)", 1)).alias("host"), text.null_if_blank(F.regexp_extract("text", r"10\.[0-9]{4,9}/[A-Za-z0-9.]+", 0)).alias("doi"))


_ISBN = "CASE WHEN length(upper(regexp_replace({0}, '[^0-9Xx]', '', 'g'))) IN (10, 13) THEN upper(regexp_replace({0}, '[^0-9Xx]', '', 'g')) END"


@query(f"""{_TROVE}, p AS (SELECT {_ISBN.format('w.isbn')} AS a, {_ISBN.format('ci')} AS b FROM x JOIN works w USING (canonical_id) JOIN (SELECT trove_work_id, min(trove_isbns[1]) AS ci FROM trove_title_candidates GROUP BY 1) USING (trove_work_id))
SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'both_omitted' WHEN b IS NULL THEN 'omitted_in_catalogue' WHEN a IS NULL THEN 'omitted_in_works' WHEN a = b THEN 'exact' ELSE 'conflict' END AS label, count(*) AS n FROM p GROUP BY 1""")
def catalogue_isbn_labels(t):
    first = t.trove.groupBy("trove_work_id").agg(F.min(F.try_element_at("trove_isbns", F.lit(1))).alias("ci"))
    pairs = catalogue_links(t).join(works(t).select("canonical_id", "isbn"), "canonical_id").join(first, "trove_work_id")
    return pairs.groupBy(disparity.isbn_label(F.col("isbn"), F.col("ci"), "works", "catalogue").alias("label")).agg(F.count("*").alias("n"))


@query(f"""{_LINK}, c AS (SELECT eid, max(citedby_count) AS cites FROM scopus_shard GROUP BY 1)
SELECT canonical_id FROM m JOIN l USING (canonical_id) LEFT JOIN c USING (eid) WHERE 2030 - reference_year >= 20 AND (cites <= 5 OR ((cites IS NULL OR cites > 5) AND title IS NULL AND reference_year < 1980))""")
def obscure_old_works(t):
    c = t.index.groupBy("eid").agg(F.max("citedby_count").alias("cites"))
    w = index_links(t).join(works(t).select("canonical_id", "title", "reference_year"), "canonical_id").join(c, "eid", "left")
    return w.filter(references.obscure_old(F.col("reference_year"), F.col("cites"), F.col("title"), F.lit(2030))).select("canonical_id")


_BOTH_LISTS = f"""{_LINK}, {_TROVE[_TROVE.index('c AS ('):]}, a AS (SELECT eid, min(author_names) AS an, max(n_authors) AS na FROM scopus_shard GROUP BY 1), b AS (SELECT trove_work_id, min(trove_contributor) AS tc FROM trove_title_candidates GROUP BY 1),
j AS (SELECT canonical_id, an, na, tc FROM m JOIN x USING (canonical_id) JOIN a USING (eid) JOIN b USING (trove_work_id))"""


def author_lists(t):
    a = t.index.groupBy("eid").agg(F.min("author_names").alias("an"), F.max("n_authors").alias("na"))
    b = t.trove.groupBy("trove_work_id").agg(F.min("trove_contributor").alias("tc"))
    both = index_links(t).select("canonical_id", "eid").join(catalogue_links(t).select("canonical_id", "trove_work_id"), "canonical_id")
    return both.join(a, "eid").join(b, "trove_work_id")


@query(f"{_BOTH_LISTS} SELECT canonical_id, CAST(na - len(tc) AS BIGINT) AS difference, len(list_intersect(an, tc)) > 0 AS shares_any FROM j WHERE an IS NOT NULL AND tc IS NOT NULL")
def author_count_concordance(t):
    return author_lists(t).filter("an IS NOT NULL AND tc IS NOT NULL").select("canonical_id", (F.col("na") - F.size("tc")).cast("long").alias("difference"), text.shares_any(F.col("an"), F.col("tc")).alias("shares_any"))


@query(f"{_BOTH_LISTS} SELECT count(*) AS n, count(*) FILTER (WHERE lower(split_part(an[1], ',', 1)) = lower(split_part(tc[1], ',', 1))) AS n_same FROM j WHERE len(an) > 0 AND len(tc) > 0")
def first_author_fidelity(t):
    family = lambda c: F.lower(F.split_part(F.try_element_at(c, F.lit(1)), F.lit(","), F.lit(1)))
    rows = author_lists(t).filter("size(an) > 0 AND size(tc) > 0")
    return rows.agg(F.count("*").alias("n"), F.count_if(family("an") == family("tc")).alias("n_same"))


_ASCII = "regexp_full_match(coalesce(title, ''), '[ -~]*') AND regexp_full_match(coalesce(ititle, ''), '[ -~]*')"


@query(f"""WITH d AS (SELECT research_output_type AS kind, title, first_value(title) OVER (PARTITION BY canonical_id ORDER BY row_id) AS ititle FROM {W}), e AS (SELECT kind, {label_sql('title', 'ititle', True)} AS label FROM d WHERE {_ASCII})
SELECT kind, label, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) >= 10""")
def labels_by_type_ascii(t):
    return typed_labels(ascii_titles(deliveries(t)))


@query()
def labels_by_type(t):
    return typed_labels(deliveries(t))


def typed_labels(rows):
    return rows.groupBy(F.col("research_output_type").alias("kind"), disparity.title(F.col("title"), F.col("ititle")).alias("label")).agg(F.count("*").alias("n")).filter("n >= 10")


@query("SELECT DISTINCT affiliation_country, affiliation_city, count(DISTINCT author) AS n_authors FROM (SELECT affiliation_country, affiliation_city, unnest(author_auids) AS author FROM scopus_shard WHERE status = 'ok') GROUP BY 1, 2")
def author_headcounts(t):
    a = t.index.filter("status = 'ok'").select("affiliation_country", "affiliation_city", F.explode("author_auids").alias("author"))
    return a.groupBy("affiliation_country", "affiliation_city").agg(F.countDistinct("author").alias("n_authors"))


@query("""SELECT trove_issued, CASE WHEN regexp_full_match(trim(trove_issued), '[0-9]+(\\.[0-9]+)?') THEN TRUE ELSE FALSE END AS is_numeric, NOT regexp_full_match(trim(trove_issued), '[0-9]+(\\.[0-9]+)?') AND (length(trove_issued) > 15 OR contains(trove_issued, ':')) AS prose, count(*) AS n FROM trove_title_candidates WHERE trove_issued IS NOT NULL GROUP BY 1, 2, 3""")
def numeric_descriptors(t):
    d = clean.numeric_descriptor(F.col("trove_issued"))
    return t.trove.filter("trove_issued IS NOT NULL").select("trove_issued", d["is_numeric"].alias("is_numeric"), (F.size(d["codes"]) > 0).alias("prose")).groupBy("trove_issued", "is_numeric", "prose").agg(F.count("*").alias("n"))


@query("""SELECT eid, CASE WHEN title IS NULL OR trim(title) = '' THEN 'E' ELSE concat_ws(',', CASE WHEN regexp_matches(title, '<[^>]+>|\\$[^$]+\\$|\\\\[a-zA-Z]+') THEN 'Q' END, CASE WHEN regexp_matches(title, '\\s*\\.\\.+$') THEN 'F' END, CASE WHEN regexp_matches(title, '\\s{2,}') THEN 'K' END) END AS codes FROM scopus_shard WHERE status = 'ok'""")
def index_title_profile(t):
    return t.index.filter("status = 'ok'").select("eid", F.array_join(clean.index_title_codes(F.col("title"), F.col("title")), ",").alias("codes"))


@query(f"SELECT row_id, regexp_full_match(outlet, '/[a-z0-9/]+') AS leaked, research_output_type IN ('Book', 'Book Chapter') AS known FROM {W} WHERE outlet IS NOT NULL AND research_output_type IS NOT NULL")
def vocabulary_leaks(t):
    vocabulary = t.spark.createDataFrame([("Book", "book"), ("Book Chapter", "book chapter")], "kind string, label string")
    rows = t.works.filter("outlet IS NOT NULL AND research_output_type IS NOT NULL").select("row_id", "outlet", "research_output_type")
    checked = clean.in_vocabulary(rows, "research_output_type", "research_output_type", vocabulary, "ok")
    return checked.select("row_id", (F.size(clean.leaked_path(F.col("outlet"))) > 0).alias("leaked"), F.coalesce("ok", F.lit(False)).alias("known"))


@query()
def golden_title_codes(t):
    """Each delivery's title against the most frequent one of its work."""
    rows = t.works.filter("title IS NOT NULL").select("canonical_id", "row_id", "title")
    g = resolve.golden(rows, "canonical_id", "title", "row_id").withColumnRenamed("title", "golden")
    return rows.join(g, "canonical_id").select("row_id", resolve.title_code(F.col("title"), F.col("golden")).alias("code"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_once(t):
    """The events as a file stream, each event kept once."""
    import uuid

    out = f"{shared_dir(t.spark)}/kollate/stream-{uuid.uuid4().hex}"
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    incremental.append_once(events, "event_id", f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema(t.events.schema).parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_targets FROM era_research_outputs_raw r WHERE title IS NOT NULL AND id NOT IN (SELECT era_id FROM trove_title_candidates WHERE era_id IS NOT NULL)")
def pending_targets(t):
    return incremental.pending(t.raw.filter("title IS NOT NULL"), t.trove.filter("era_id IS NOT NULL").select(F.col("era_id").alias("id")), "id").agg(F.count("*").alias("n_targets"))
