"""Processed rows, rules by id, rollups of matches, audits of references and their accuracy."""

from pyspark.sql import functions as F

from kollate.functions import text
from kollate.operators import clean, disparity, records, references, resolve, rollup
from kollate.plans.linkage import DOI, WORKS, index_links, works
from kollate.plans.linkage import _LINK
from kollate.plans.registry import query
from kollate.plans.scalars import _OK, _PRE

W, R = "era_research_outputs_canonical", "era_research_outputs_raw"

#: The words of the cleaners and detectors, for the oracle.
_MISSING = ", ".join(f"'{w}'" for w in text.DISGUISED_NULLS)
_YEARS = r"(1[5-9][0-9]{2}|20[0-4][0-9])"
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{0,2}"
_RANGE = f"{_YEARS}{_SPACE}[-‐‑‒–—―−_]{{0,2}}{_SPACE}{_YEARS}"
#: A year range by parts: what is between the years, and whether that is one hyphen.
_RANGE_SQL = f"""CASE WHEN NOT regexp_matches(title, '{_RANGE}') THEN NULL WHEN substr(regexp_extract(title, '{_RANGE}', 0), 5, 1) = '-' AND length(regexp_extract(title, '{_RANGE}', 0)) = 9 THEN 'valid' ELSE 'adjusted' END"""


def _processed(t):
    rows = t.raw.select("id", "institution", "research_output_type", "title", "doi", "isbn", "outlet", "publisher", "reference_year").distinct()
    return records.processed(rows, ["isbn", "outlet", "publisher"])


@query(f"""WITH d AS (SELECT DISTINCT id, institution, research_output_type, title, doi, isbn, outlet, publisher, reference_year FROM {R}),
s AS (SELECT *, length(trim(doi)) > 0 AS dp, length(trim(title)) > 0 AS tp, lower(doi) AS v FROM d),
p AS (SELECT *, regexp_replace(v, {_PRE}, '') AS s, trim(v) AS k, trim(regexp_replace(v, {_PRE}, '')) AS sk, regexp_full_match(v, {_OK}) AS fine FROM s)
SELECT id, institution, CASE WHEN coalesce(dp, FALSE) THEN 'present' ELSE 'missing' END AS doi_presence, CASE WHEN dp THEN CASE WHEN fine THEN v ELSE sk END END AS doi, CASE WHEN dp THEN fine OR regexp_full_match(sk, {_OK}) END AS doi_wellformed,
  CASE WHEN dp AND NOT fine AND regexp_full_match(sk, {_OK}) THEN concat_ws(',', CASE WHEN NOT regexp_full_match(k, {_OK}) THEN 'S' END, CASE WHEN NOT regexp_full_match(s, {_OK}) THEN 'K' END) ELSE '' END AS doi_provenance,
  CASE WHEN coalesce(tp, FALSE) THEN 'present' ELSE 'missing' END AS title_presence, CASE WHEN tp THEN regexp_matches(title, '</?[a-zA-Z][a-zA-Z0-9]*\\s*/?>') END AS title_has_html, CASE WHEN tp THEN regexp_matches(title, '\\\\[a-zA-Z]+') END AS title_has_tex,
  CASE WHEN tp THEN regexp_matches(regexp_replace(title, '[\\p{{Latin}}\\p{{Common}}]', '', 'g'), '\\p{{L}}') END AS title_has_non_latin, CASE WHEN tp THEN {_RANGE_SQL} END AS title_daterange_status,
  CASE WHEN isbn IS NULL OR trim(isbn) = '' OR lower(trim(isbn)) IN ({_MISSING}) THEN 'missing' ELSE 'present' END AS isbn_presence,
  CASE WHEN outlet IS NULL OR trim(outlet) = '' OR lower(trim(outlet)) IN ({_MISSING}) THEN 'missing' ELSE 'present' END AS outlet_presence,
  CASE WHEN publisher IS NULL OR trim(publisher) = '' OR lower(trim(publisher)) IN ({_MISSING}) THEN 'missing' ELSE 'present' END AS publisher_presence, reference_year FROM p""")
def processed_submissions(t):
    """Presence, clean DOI, signs of the title and presence of the other fields of every submission."""
    kept = ["doi_presence", "doi", "doi_wellformed", "title_presence", "title_has_html", "title_has_tex", "title_has_non_latin", "title_daterange_status", "isbn_presence", "outlet_presence", "publisher_presence", "reference_year"]
    return _processed(t).select("id", "institution", F.array_join("doi_provenance", ",").alias("doi_provenance"), *kept)


@query()
def processed_fields(t):
    """The clean values of the text fields and the codes of all fields of every submission."""
    fields = ["title", "outlet", "publisher", "isbn"]
    return _processed(t).select("id", "institution", *fields, *[f"{f}_wellformed" for f in fields], *[F.array_join(f"{f}_provenance", ",").alias(f"{f}_provenance") for f in fields])


_PAIR = f"""f AS (SELECT id, first(doi ORDER BY submitted_at, institution, title, doi) AS rd FROM {R} GROUP BY id), p AS (SELECT canonical_id, lower(doi) AS a, lower(rd) AS b FROM works JOIN f ON id = canonical_id),
c AS (SELECT canonical_id, CASE WHEN regexp_full_match(a, {_OK}) THEN a ELSE trim(regexp_replace(a, {_PRE}, '')) END AS x, CASE WHEN regexp_full_match(b, {_OK}) THEN b ELSE trim(regexp_replace(b, {_PRE}, '')) END AS y FROM p)"""


@query(f"WITH {WORKS}, {_PAIR} SELECT canonical_id, CASE WHEN x = y THEN x END AS value, coalesce(x = y, FALSE) AS same FROM c")
def doi_matches(t):
    """Each work's DOI against the one of the submission of the same number, both cleaned."""
    order = F.struct(*[x for c in ("submitted_at", "institution", "title", "doi") for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])
    first = t.raw.groupBy("id").agg(F.min_by("doi", order).alias("rd"))
    pairs = works(t).join(first, F.col("id") == F.col("canonical_id"))
    match = records.classify_match(F.col("doi"), F.col("rd"), clean.DOI)
    return pairs.select("canonical_id", match["value"].alias("value"), match["wellformed"].alias("same"))


_LOW = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query(f"""WITH l AS (SELECT delivered_by AS k, min(institution_name) AS t FROM (SELECT DISTINCT delivered_by FROM {W}) JOIN era_institutions ON delivered_by = institution GROUP BY 1)
SELECT row_id, trim(publisher) AS value, CASE WHEN length(t) > 0 THEN {_LOW.format('publisher')} = {_LOW.format('t')} END AS wellformed FROM {W} LEFT JOIN l ON delivered_by = k WHERE publisher IS NOT NULL""")
def names_by_list(t):
    """Publishers held against the name that the list of institutions has for the deliverer's code."""
    rows = t.works.filter("publisher IS NOT NULL").select("row_id", "publisher", "delivered_by")
    checked = records.listed_title(rows, "publisher", "delivered_by", t.era_institutions.select("institution", "institution_name"), "c")
    return checked.select("row_id", "c.value", "c.wellformed")


@query()
def names_by_agreement(t):
    """Outlets held against the name that most records with the same ISBN have."""
    rows = t.works.filter("outlet IS NOT NULL").select("row_id", "outlet", text.isbn("outlet_isbn").alias("key"))
    checked = records.agreed_name(rows, "outlet", "key", clean.consensus_vocabulary(rows, "key", "outlet"), "c")
    return checked.select("row_id", "c.value", "c.wellformed", F.array_join("c.codes", ",").alias("codes"))


#: The engines write a sigma at a word's end differently in small letters.
_MATCHES = f"""a AS (SELECT r.id, s.eid, 'doi' AS match_type, 1 AS src FROM {R} r JOIN scopus_shard s ON {DOI.format('r.doi')} = lower(trim(s.doi_normalized)) WHERE s.eid IS NOT NULL),
b AS (SELECT r.id, s.eid, 'title' AS match_type, 2 AS src FROM {R} r JOIN scopus_shard s ON replace(lower(trim(r.title)), 'ς', 'σ') = replace(lower(trim(s.title)), 'ς', 'σ') WHERE s.eid IS NOT NULL AND length(trim(r.title)) >= 15)"""


def _submission_matches(t):
    index = t.index.filter("eid IS NOT NULL")
    by_doi = t.raw.select("id", text.doi("doi").alias("k")).dropna().distinct().join(index.select(F.lower(F.trim("doi_normalized")).alias("k"), "eid").dropna().distinct(), "k").select("id", "eid", F.lit("doi").alias("match_type"))
    titled = t.raw.filter(F.length(F.trim("title")) >= 15).select("id", text.plain_title("title").alias("k")).distinct()
    by_title = titled.join(index.select(text.plain_title("title").alias("k"), "eid").dropna().distinct(), "k").select("id", "eid", F.lit("title").alias("match_type"))
    return by_doi, by_title


@query(f"""WITH {WORKS}, {_MATCHES}, u AS (SELECT canonical_id, unnest(source_ids) AS id FROM works), m AS (SELECT * FROM a UNION ALL SELECT * FROM b),
k AS (SELECT canonical_id, eid, match_type, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE match_type WHEN 'doi' THEN 1 WHEN 'title' THEN 2 ELSE 3 END, src, eid) AS n FROM u JOIN m USING (id))
SELECT w.canonical_id, eid, match_type AS match_tier, eid IS NOT NULL AS matched FROM works w LEFT JOIN (SELECT * FROM k WHERE n = 1) k USING (canonical_id)""")
def index_rollup(t):
    """Works with the best match of any of their submissions: by DOI before by title, then by table, then by the smallest id."""
    return rollup.matches_of_works(works(t).select("canonical_id", "source_ids"), list(_submission_matches(t)), "eid")


_SOURCES = f"""WITH {WORKS}, {_MATCHES}, u AS (SELECT canonical_id, unnest(source_ids) AS id FROM works),
s AS (SELECT w.canonical_id, canonical_id IN (SELECT canonical_id FROM u JOIN a USING (id)) AS by_doi, canonical_id IN (SELECT canonical_id FROM u JOIN b USING (id)) AS by_title,
  canonical_id IN (SELECT canonical_id FROM u JOIN trove_title_candidates c ON c.era_id = u.id WHERE trove_work_id IS NOT NULL) AS in_catalogue FROM works w)"""


@query(f"{_SOURCES} SELECT by_doi, by_title, in_catalogue, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS share FROM s GROUP BY 1, 2, 3")
def source_combinations(t):
    """Works by which of three external sources has any of their submissions."""
    w = works(t).select("canonical_id", "source_ids")
    ids = w.select("canonical_id", F.explode("source_ids").alias("id"))
    by_doi, by_title = _submission_matches(t)
    harvested = t.trove.filter("era_id IS NOT NULL AND trove_work_id IS NOT NULL").select(F.col("era_id").alias("id"))
    out = w.select("canonical_id")
    for name, found in (("by_doi", by_doi), ("by_title", by_title), ("in_catalogue", harvested)):
        has = ids.join(found.select("id").distinct(), "id", "left_semi").select("canonical_id").distinct().withColumn(name, F.lit(True))
        out = out.join(has, "canonical_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    counted = out.groupBy("by_doi", "by_title", "in_catalogue").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))  # one row
    return counted.join(F.broadcast(total)).select("by_doi", "by_title", "in_catalogue", "n", F.round(F.col("n") * 100.0 / F.col("all"), 2).cast("double").alias("share"))


@query("""SELECT doi_normalized, status, eid FROM (SELECT *, row_number() OVER (PARTITION BY doi_normalized ORDER BY CASE status WHEN 'ok' THEN 1 WHEN 'not_found' THEN 2 ELSE 3 END, eid NULLS LAST) AS k FROM (SELECT DISTINCT doi_normalized, status, eid FROM scopus_shard WHERE doi_normalized IS NOT NULL)) WHERE k = 1""")
def preferred_lookups(t):
    """Of each DOI's lookups the one that found something, else any."""
    rows = t.index.select("doi_normalized", "status", "eid").distinct().withColumn("tie", F.struct(F.col("eid").isNull(), "eid"))
    return rollup.preferred_status(rows, "doi_normalized", "status", "tie").select("doi_normalized", "status", "eid")


_EDGES = "e AS (SELECT l_orderkey AS citer, year(o_orderdate) AS citing_year, year(l_shipdate) - l_linenumber * 17 AS cited_year, CAST(p_size AS BIGINT) AS cites, year(o_orderdate) - (year(l_shipdate) - l_linenumber * 17) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
_AUDITED = "age < 0 AS anachronisms, age <= -5 AS severe_anachronisms, age >= 20 AND cites <= 5 AS obscure_20y, age >= 30 AND cites <= 5 AS obscure_30y, age >= 50 AND cites <= 5 AS obscure_50y, age >= 100 AND cites <= 5 AS obscure_100y"
_NAMES = ("anachronisms", "severe_anachronisms", "obscure_20y", "obscure_30y", "obscure_50y", "obscure_100y")


def _edges(t):
    """Edges of a citation graph made of order lines, whose ages run from below nought to above a hundred."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("citer"), F.year("o_orderdate").alias("citing_year"), (F.year("l_shipdate") - F.col("l_linenumber") * 17).alias("cited_year"), F.col("p_size").alias("cites"))


@query(f"WITH {_EDGES}, c AS (SELECT *, {_AUDITED} FROM e) SELECT count(*) AS total_refs, {', '.join(f'count(*) FILTER (WHERE {n}) AS {n}' for n in _NAMES)}, count(*) FILTER (WHERE age BETWEEN 0 AND 19) AS recent_refs, count(*) FILTER (WHERE age >= 20) AS historical_refs FROM c")
def corpus_audit_references(t):
    return references.audit_references(_edges(t))


@query(f"WITH {_EDGES}, c AS (SELECT *, {_AUDITED} FROM e), p AS (SELECT citer, {', '.join(f'bool_or({n}) AS {n}' for n in _NAMES)} FROM c GROUP BY 1) SELECT count(*) AS total_papers, {', '.join(f'count(*) FILTER (WHERE {n}) AS papers_with_{n}' for n in _NAMES)} FROM p")
def corpus_audit_papers(t):
    return references.audit_papers(_edges(t))


@query()
def paper_audit(t):
    """Index records of an affiliation's city as one reference list: inversions, obscure and lonely old works."""
    refs = t.index.filter("status = 'ok' AND eid IS NOT NULL AND affiliation_city IS NOT NULL").groupBy("eid").agg(F.min("affiliation_city").alias("paper"), F.min("title").alias("title"), F.min("author_names").alias("names"), F.max("citedby_count").alias("cites"))
    refs = refs.select("paper", F.col("eid").alias("ref"), F.row_number().over(resolve.Window.partitionBy("paper").orderBy("eid")).alias("position"), text.first_surname(F.try_element_at("names", F.lit(1))).alias("surname"), "title", text.year_in("title").alias("year"), F.lit(2018).alias("citing"), "cites")
    return references.audit_list(refs, "paper", "ref", "surname", "position", "title", "year", "citing", "cites")


_LINKED = f"""WITH {WORKS}, w AS (SELECT canonical_id, title AS cited_title, reference_year AS cited_year, {DOI.format('doi')} AS k FROM works), r AS (SELECT DISTINCT id, title AS ref_title, reference_year AS ref_year, {DOI.format('doi')} AS k FROM {R}),
g AS (SELECT canonical_id, count(*) AS c, bool_or(regexp_matches(lower(coalesce(section, '')), '{'|'.join(references.SECTIONS['in_methods'])}')) AS im, bool_or(regexp_matches(lower(coalesce(section, '')), '{'|'.join(references.SECTIONS['in_intro'])}')) AS ii,
  bool_or(regexp_matches(lower(coalesce(section, '')), '{'|'.join(references.SECTIONS['in_discuss'])}')) AS idc, bool_or(regexp_matches(lower(coalesce(section, '')), '{'|'.join(references.SECTIONS['in_results'])}')) AS ir FROM documents WHERE canonical_id IS NOT NULL GROUP BY 1),
j AS (SELECT *, coalesce(c, 0) AS m, coalesce(cited_title = ref_title AND cited_title <> '', FALSE) AS exact, coalesce(abs(cited_year - ref_year) > 0, FALSE) AS year_differs FROM w JOIN r USING (k) LEFT JOIN g USING (canonical_id) WHERE length(k) > 5)"""
_SHARES = "count(*) AS total_citations, round(avg(exact::INT) * 100.0, 2) AS pct_exact_title, round(avg(year_differs::INT) * 100.0, 2) AS pct_year_disparity, round(avg(m), 2) AS mean_mentions"
_TIER = "CASE WHEN m = 0 THEN '0 (Uncited in body)' WHEN m = 1 THEN '1 (Passing citation)' WHEN m IN (2, 3) THEN '2-3 (Moderate)' WHEN m BETWEEN 4 AND 6 THEN '4-6 (Substantive)' ELSE '7+ (Foundational)' END"


def _judged(t):
    """Submissions as references to the works with the same DOI, with the works' mentions in documents."""
    w = works(t).select("canonical_id", F.col("title").alias("cited_title"), F.col("reference_year").alias("cited_year"), text.doi("doi").alias("k"), "research_output_type").filter("length(k) > 5")
    r = t.raw.select("id", F.col("title").alias("ref_title"), F.col("reference_year").alias("ref_year"), text.doi("doi").alias("k")).distinct()
    mentions = references.mention_groups(t.documents.filter("canonical_id IS NOT NULL"), ["canonical_id"], "section")
    return references.judged(w.join(r, "k").join(mentions, "canonical_id", "left"))


_CHECKED = ("total_citations", "pct_exact_title", "pct_year_disparity", "mean_mentions")


@query(f"{_LINKED} SELECT {_TIER} AS importance_tier, {_SHARES} FROM j GROUP BY 1")
def accuracy_by_importance(t):
    return references.accuracy(_judged(t), "importance_tier").select("importance_tier", *_CHECKED)


@query(f"{_LINKED} SELECT CASE WHEN im THEN 'Methods/Data/Materials' WHEN ir THEN 'Results/Findings' WHEN idc THEN 'Discussion/Conclusions' WHEN ii THEN 'Introduction/Background' ELSE 'Other/Uncited in body' END AS section_group, {_SHARES} FROM j GROUP BY 1")
def accuracy_by_section(t):
    return references.accuracy(_judged(t), "section_group").select("section_group", *_CHECKED)


@query()
def accuracy_by_type(t):
    """All shares of title labels and types by the type of the cited work, where it was cited often enough."""
    return references.accuracy(_judged(t), "research_output_type", least=50)


@query("SELECT eid, i AS position, author_auids[i] AS doi, author_names[i] AS title FROM (SELECT eid, author_auids, author_names, unnest(range(1, len(author_names) + 1)) AS i FROM (SELECT eid, first(author_names ORDER BY k) AS author_names, first(author_auids ORDER BY k) AS author_auids FROM (SELECT DISTINCT eid, author_names, author_auids, CAST(author_names AS VARCHAR) || CAST(author_auids AS VARCHAR) AS k FROM scopus_shard WHERE eid IS NOT NULL AND author_names IS NOT NULL AND len(author_names) = len(author_auids)) GROUP BY 1 HAVING count(*) = 1))")
def reference_items(t):
    """Lists of an index answer as reference items; places missing in the answer are those in the list."""
    rows = t.index.filter("eid IS NOT NULL AND author_names IS NOT NULL AND size(author_names) = size(author_auids)").select("eid", "author_names", "author_auids").distinct()
    single = rows.groupBy("eid").agg(F.count("*").alias("n"), F.min(F.struct("author_names", "author_auids")).alias("x")).filter("n = 1")
    item = lambda name, number: F.struct(F.lit(None).cast("string").alias("position"), name.alias("title"), F.lit("n.d.").alias("year"), number.alias("doi"))
    lists = single.select("eid", F.zip_with("x.author_names", "x.author_auids", item).alias("items"))
    return references.reference_items(lists, "eid", "items").select("eid", F.col("position").cast("long").alias("position"), "title", "doi")


@query(f"WITH {WORKS}, u AS (SELECT canonical_id, i AS position, source_ids[i] AS id FROM (SELECT canonical_id, source_ids, unnest(range(1, least(2, len(source_ids)) + 1)) AS i FROM works)), s AS (SELECT id, min(title) AS title FROM {R} GROUP BY 1) SELECT canonical_id, position, id, title FROM u JOIN s USING (id)")
def listed_works(t):
    """The first two submissions that each work lists, in the list's order."""
    titles = t.raw.groupBy("id").agg(F.min("title").alias("title"))
    found = references.listed_works(works(t).select("canonical_id", "source_ids"), "canonical_id", "source_ids", titles, "id", 2)
    return found.select("canonical_id", F.col("position").cast("long").alias("position"), "id", "title")


@query(f"""{_LINK}, c AS (SELECT eid, max(citedby_count) AS cites FROM scopus_shard GROUP BY 1)
SELECT canonical_id, eid, cites FROM m JOIN l USING (canonical_id) JOIN c USING (eid) WHERE cites > 40 AND reference_year BETWEEN 2010 AND 2014 AND canonical_id IN (SELECT canonical_id FROM (SELECT canonical_id, unnest(source_ids) AS era_id FROM l) JOIN trove_title_candidates USING (era_id)) ORDER BY canonical_id LIMIT 5""")
def audit_sample(t):
    """The first five works of some years that two sources have and that are cited more than forty times."""
    cites = t.index.groupBy("eid").agg(F.max("citedby_count").alias("cites"))
    harvested = works(t).select("canonical_id", F.explode("source_ids").alias("era_id")).join(t.trove.select("era_id").dropna().distinct(), "era_id", "left_semi").select("canonical_id").distinct()
    rows = index_links(t).join(works(t).select("canonical_id", "reference_year"), "canonical_id").join(cites, "eid").join(harvested, "canonical_id", "left_semi")
    return rows.filter("cites > 40 AND reference_year BETWEEN 2010 AND 2014").select("canonical_id", "eid", "cites").orderBy("canonical_id").limit(5)


@query(f"SELECT count(DISTINCT CAST(title_provenance AS VARCHAR)) AS n_codes, count(DISTINCT CAST(institutions AS VARCHAR)) AS n_lists FROM {W}")
def distinct_lists(t):
    return t.works.agg(F.countDistinct(F.to_json("title_provenance")).alias("n_codes"), F.countDistinct(F.to_json("institutions")).alias("n_lists"))


@query("""SELECT trove_work_id, trove_url, CASE WHEN regexp_matches(lower(trove_url), '(arxiv|journals\\.plos|europepmc)\\.org|frontiersin\\.org|(mdpi|biomedcentral)\\.com') THEN 0 WHEN regexp_matches(lower(trove_url), 'edu\\.au|(anu|usyd|unsw|uq|unimelb|curtin|qut|monash|adelaide)\\.edu') THEN 1
  WHEN regexp_matches(lower(trove_url), '(zenodo|osf|biorxiv|medrxiv)\\.(org|io)|figshare\\.com|researchgate\\.net') THEN 2 ELSE 3 END AS tier FROM (SELECT DISTINCT trove_work_id, trove_url FROM trove_title_candidates WHERE trove_url IS NOT NULL)""")
def address_tiers(t):
    return t.trove.filter("trove_url IS NOT NULL").select("trove_work_id", "trove_url").distinct().withColumn("tier", text.address_tier("trove_url"))


@query("""WITH n AS (SELECT trove_contributor[1] AS who, trim(trove_contributor[1]) AS x FROM (SELECT DISTINCT trove_contributor FROM trove_title_candidates) WHERE len(trove_contributor) > 0 AND NOT contains(trove_contributor[1], ';')),
p AS (SELECT who, x, regexp_split_to_array(x, '\\s+') AS w FROM n)
SELECT DISTINCT who, nullif(upper(regexp_replace(CASE WHEN contains(x, ',') THEN split_part(x, ',', 1) WHEN len(w) >= 2 AND length(rtrim(w[len(w)], '.')) <= 2 AND length(w[1]) > 2 THEN w[1] ELSE w[len(w)] END, '[^a-zA-Z]', '', 'g')), '') AS surname FROM p""")
def first_surnames(t):
    who = F.try_element_at("trove_contributor", F.lit(1))
    return t.trove.select(who.alias("who")).filter("who IS NOT NULL AND NOT contains(who, ';')").distinct().withColumn("surname", text.first_surname("who"))
