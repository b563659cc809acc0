"""Reference diagnostics, people, harvest profiles and report tables."""

from pyspark.sql import Window, functions as F

from kollate.functions import text
from kollate.operators import disparity, references
from kollate.plans.linkage import works
from kollate.plans.registry import query

W = "era_research_outputs_canonical"


@query("""WITH a AS (SELECT DISTINCT eid, author_names FROM scopus_shard WHERE status = 'ok' AND eid IS NOT NULL), b AS (SELECT eid, min(author_names) AS names FROM a GROUP BY 1),
p AS (SELECT eid, unnest(range(1, len(names) + 1)) AS pos, names FROM b), s AS (SELECT eid, pos, upper(regexp_replace(split_part(names[pos], ',', 1), '[^a-zA-Z]', '', 'g')) AS s FROM p),
q AS (SELECT *, lag(s) OVER w AS prev, count(*) OVER (PARTITION BY eid) AS n FROM s WHERE s <> '' WINDOW w AS (PARTITION BY eid ORDER BY pos)),
r AS (SELECT *, avg(CASE WHEN prev IS NULL THEN NULL WHEN prev <= s THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY eid) AS ratio FROM q),
m AS (SELECT *, max({'s': s, 'p': pos}) OVER (PARTITION BY eid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r WHERE n >= 4 AND ratio >= 0.6)
SELECT eid, pos, s AS surname, top.s AS previous, top.p AS previous_position, abs(ascii(top.s) - ascii(s)) AS distance, abs(ascii(top.s) - ascii(s)) >= 2 AS major FROM m WHERE s < top.s""")
def author_order_inversions(t):
    """Authors out of the alphabetical order that most of their list keeps."""
    lists = t.index.filter("status = 'ok' AND eid IS NOT NULL").groupBy("eid").agg(F.min("author_names").alias("names"))
    names = lists.select("eid", F.posexplode("names").alias("p", "name")).select("eid", (F.col("p") + 1).cast("long").alias("pos"), text.null_if_blank(F.upper(F.regexp_replace(F.split_part("name", F.lit(","), F.lit(1)), "[^a-zA-Z]", ""))).alias("surname"))
    return references.inversions(names, "eid", "surname", "pos", 4, 0.6)


@query(f"""WITH a AS (SELECT canonical_id, regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') AS k FROM {W} WHERE title IS NOT NULL),
x AS (SELECT canonical_id, list(DISTINCT k) FILTER (WHERE length(k) > 8) AS x FROM a GROUP BY 1),
b AS (SELECT id, regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') AS k FROM era_research_outputs_raw WHERE title IS NOT NULL),
y AS (SELECT id, list(DISTINCT k) FILTER (WHERE length(k) > 8) AS y FROM b GROUP BY 1),
j AS (SELECT canonical_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM x JOIN y ON id = canonical_id)
SELECT canonical_id, len(x) AS n_a, len(y) AS n_b, len(list_intersect(x, y)) AS shared, len(x) - len(list_intersect(x, y)) AS only_a, len(y) - len(list_intersect(x, y)) AS only_b,
  round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM j""")
def delivered_against_submitted(t):
    a = t.works.groupBy("canonical_id").agg(F.collect_set("title").alias("a"))
    b = t.raw.groupBy("id").agg(F.collect_set("title").alias("b"))
    c = a.join(b, F.col("canonical_id") == F.col("id")).filter("size(a) > 0 AND size(b) > 0").select("canonical_id", references.compare_lists(F.col("a"), F.col("b")).alias("c"))
    return c.select("canonical_id", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("n_a", "n_b", "shared", "only_a", "only_b")], F.round("c.jaccard", 6).alias("jaccard"))


_STOP = "['the','a','an','and','or','of','in','on','at','to','for','with','by','as','is','are','was','were','from','that','this','between','into','through','after','before','using','study','analysis','role']"


@query(f"""WITH r AS (SELECT outlet, row_id, title, reference_year, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP}, w))) AS k FROM {W} WHERE length(title) > 5 AND outlet IS NOT NULL),
v AS (SELECT * FROM r WHERE outlet IN (SELECT outlet FROM r GROUP BY 1 HAVING count(*) >= 5)), w AS (SELECT outlet, row_id, unnest(k) AS t FROM v), d AS (SELECT outlet, t FROM w GROUP BY 1, 2 HAVING count(*) > 1)
SELECT outlet, row_id, title, reference_year FROM v WHERE 2018 - reference_year >= 8 AND len(k) > 0 AND row_id NOT IN (SELECT w.row_id FROM w JOIN d ON w.outlet = d.outlet AND w.t = d.t)""")
def outlet_orphans(t):
    """Older works of an outlet that share no word with its others."""
    r = t.works.filter("outlet is not null").select("outlet", "row_id", "title", "reference_year", F.lit(2018).alias("citing"))
    return references.orphans(r, "outlet", "row_id", "title", "reference_year", "citing", 5, 8)


@query("""WITH e AS (SELECT l_orderkey AS citer, year(l_shipdate) - year(o_orderdate) AS age, p_retailprice AS cites, p_type AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT citer, count(*) AS n_refs, count(*) FILTER (WHERE age < 0) AS n_future, count(*) FILTER (WHERE age >= 1) AS n_old, max(age) AS max_age FROM e GROUP BY 1""")
def anachronism_audit(t):
    """Each paper's edges joined to both nodes: references younger than the paper, and old ones."""
    e = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("citer"), (F.year("l_shipdate") - F.year("o_orderdate")).cast("long").alias("age"))
    return e.groupBy("citer").agg(F.count("*").alias("n_refs"), F.count_if(F.col("age") < 0).alias("n_future"), F.count_if(F.col("age") >= 1).alias("n_old"), F.max("age").alias("max_age"))


@query("""SELECT canonical_id, count(*) AS mention_count, bool_or(coalesce(lower(section) LIKE '%method%' OR lower(section) LIKE '%data%' OR lower(section) LIKE '%material%' OR lower(section) LIKE '%procedur%', FALSE)) AS in_methods,
  bool_or(coalesce(lower(section) LIKE '%result%' OR lower(section) LIKE '%finding%', FALSE)) AS in_results, any_value(primary_section) AS primary_section
FROM documents JOIN (SELECT canonical_id, first(s ORDER BY n DESC, s) AS primary_section FROM (SELECT canonical_id, coalesce(section, 'UNSPECIFIED') AS s, count(*) AS n FROM documents WHERE canonical_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (canonical_id) GROUP BY 1""")
def work_mentions(t):
    d = t.documents.filter("canonical_id is not null")
    return references.mention_groups(d, ["canonical_id"], "section").select("canonical_id", "mention_count", "in_methods", "in_results", "primary_section")


_NDOI = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '')"
_NT = "lower(trim(regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g')))"
_REFS = f"""w AS (SELECT canonical_id, first(title ORDER BY row_id) AS title, first(doi ORDER BY row_id) AS doi, first(reference_year ORDER BY row_id) AS reference_year FROM {W} GROUP BY 1),
wn AS (SELECT canonical_id, {_NT.format('title')} AS wt, {_NDOI.format('doi')} AS wd FROM w), r AS (SELECT DISTINCT eid AS ref, title, doi_normalized AS doi FROM scopus_shard WHERE eid IS NOT NULL),
rn AS (SELECT ref, doi, {_NT.format('title')} AS tk, {_NDOI.format('doi')} AS dk FROM r), d AS (SELECT ref, canonical_id, 'doi_exact' AS match_tier FROM rn JOIN wn ON dk = wd WHERE length(dk) > 5),
u AS (SELECT wt, min(canonical_id) AS canonical_id FROM wn WHERE length(wt) >= 20 GROUP BY 1 HAVING count(*) = 1),
links AS (SELECT * FROM d UNION ALL SELECT ref, u.canonical_id, 'title_exact' FROM rn JOIN u ON tk = wt WHERE (doi IS NULL OR length(trim(doi)) <= 5) AND ref NOT IN (SELECT ref FROM d))"""


@query(f"WITH {_REFS} SELECT ref, canonical_id, match_tier FROM links")
def reference_linkage(t):
    refs = t.index.filter("eid is not null").select(F.lit(0).alias("paper"), F.col("eid").alias("ref"), "title", F.col("doi_normalized").alias("doi"), F.lit(None).cast("int").alias("year")).distinct()
    return references.reference_links(refs, works(t)).select("ref", "canonical_id", "match_tier")


_SPEC = f"""WITH v AS (SELECT canonical_id, title, count(DISTINCT delivered_by) AS k FROM {W} WHERE title IS NOT NULL AND length(trim(title)) > 0 GROUP BY 1, 2), s AS (SELECT k, count(*) AS n_variants, CAST(k * count(*) AS BIGINT) AS n_citations FROM v GROUP BY 1)"""


def _spectrum(t):
    return references.spectrum(t.works.filter(text.present("title")), ["canonical_id", "title"], "delivered_by")


@query(f"{_SPEC} SELECT * FROM s")
def variant_spectrum(t):
    return _spectrum(t)


@query(f"""{_SPEC}, o AS (SELECT CAST(sum(n_variants) AS BIGINT) AS n_variants, CAST(sum(n_citations) AS BIGINT) AS n_citations, CAST(coalesce(sum(CASE WHEN k = 1 THEN n_variants END), 0) AS BIGINT) AS n_single FROM s),
r AS (SELECT *, n_single / n_citations AS rho FROM o) SELECT n_variants, n_citations, n_single, round(rho, 6) AS rho, round(rho / (1 - rho), 6) AS gamma, round(1 + rho / (1 - rho), 6) AS alpha FROM r""")
def copying_model(t):
    return references.copying(_spectrum(t))


@query(f"""WITH d AS (SELECT canonical_id, title, min(delivered_at) AS first_at, max(delivered_at) AS last_at, count(DISTINCT delivered_by) AS k FROM {W} WHERE title IS NOT NULL GROUP BY 1, 2)
SELECT canonical_id, title, k, date_diff('year', first_at, last_at) AS span FROM d WHERE k > 1 ORDER BY k DESC, canonical_id, title LIMIT 10""")
def most_copied_variants(t):
    d = t.works.filter("title is not null").groupBy("canonical_id", "title").agg(F.countDistinct("delivered_by").alias("k"), (F.year(F.max("delivered_at")) - F.year(F.min("delivered_at"))).cast("long").alias("span")).filter("k > 1")
    return d.select("canonical_id", "title", "k", "span").orderBy(F.desc("k"), "canonical_id", "title").limit(10)


@query(f"""SELECT CASE WHEN n_submissions = 0 THEN '0 (Uncited in body)' WHEN n_submissions = 1 THEN '1 (Passing citation)' WHEN n_submissions <= 3 THEN '2-3 (Moderate)' WHEN n_submissions <= 6 THEN '4-6 (Substantive)' ELSE '7+ (Foundational)' END AS tier,
  count(*) AS n, round(avg((doi_wellformed)::INT) * 100, 2) AS pct_doi FROM {W} WHERE n_submissions IS NOT NULL GROUP BY 1""")
def importance_tiers(t):
    return t.works.filter("n_submissions is not null").groupBy(references.importance(F.col("n_submissions")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("doi_wellformed").cast("double")) * 100, 2).alias("pct_doi"))


_PEOPLE = """i AS (SELECT DISTINCT lower(regexp_replace(split_part(n, ',', 1), '[^a-zA-Z]', '', 'g')) || '|' || lower(substr(trim(split_part(n, ',', 2)), 1, 1)) AS person FROM (SELECT unnest(author_names) AS n FROM scopus_shard) WHERE contains(n, ',')),
c AS (SELECT DISTINCT lower(regexp_replace(split_part(n, ',', 1), '[^a-zA-Z]', '', 'g')) || '|' || lower(substr(trim(split_part(n, ',', 2)), 1, 1)) AS person FROM (SELECT unnest(trove_contributor) AS n FROM trove_title_candidates) WHERE contains(n, ',')),
p AS (SELECT person, bool_or(src = 'i') AS in_index, bool_or(src = 'c') AS in_catalogue FROM (SELECT person, 'i' AS src FROM i UNION ALL SELECT person, 'c' FROM c) GROUP BY 1)"""


def people(t):
    def keyed(df, column, source):
        n = F.col("n")
        key = F.concat(F.lower(F.regexp_replace(F.split_part(n, F.lit(","), F.lit(1)), "[^a-zA-Z]", "")), F.lit("|"), F.lower(F.substring(F.trim(F.split_part(n, F.lit(","), F.lit(2))), 1, 1)))
        return df.select(F.explode(column).alias("n")).filter(F.contains(n, F.lit(","))).select(key.alias("person"), F.lit(source).alias("src")).distinct()

    both = keyed(t.index, "author_names", "i").unionByName(keyed(t.trove, "trove_contributor", "c"))
    return both.groupBy("person").agg(F.bool_or(F.col("src") == "i").alias("in_index"), F.bool_or(F.col("src") == "c").alias("in_catalogue"))


@query(f"WITH {_PEOPLE} SELECT in_index, in_catalogue, count(*) AS n_persons FROM p GROUP BY 1, 2")
def person_overlap(t):
    return people(t).groupBy("in_index", "in_catalogue").agg(F.count("*").alias("n_persons"))


@query("""WITH a AS (SELECT DISTINCT eid, unnest(author_auids) AS author FROM scopus_shard WHERE eid IS NOT NULL), k AS (SELECT author, count(*) AS k FROM a GROUP BY 1)
SELECT CASE WHEN k <= 5 THEN CAST(k AS VARCHAR) WHEN k <= 10 THEN '6-10' ELSE '11+' END AS works, count(*) AS n_authors FROM k GROUP BY 1""")
def author_multiplicity(t):
    k = t.index.filter("eid is not null").select("eid", F.explode("author_auids").alias("author")).distinct().groupBy("author").agg(F.count("*").alias("k"))
    return k.groupBy(F.when(F.col("k") <= 5, F.col("k").cast("string")).when(F.col("k") <= 10, "6-10").otherwise("11+").alias("works")).agg(F.count("*").alias("n_authors"))


@query("""SELECT affiliation_country, count(*) AS n, CAST(sum(n_authors) AS BIGINT) AS n_authors, round(avg(openaccess_flag::INT) * 100, 2) AS pct_open, max(citedby_count) AS max_cites FROM scopus_shard WHERE status = 'ok' GROUP BY 1""")
def index_profile(t):
    return t.index.filter("status = 'ok'").groupBy("affiliation_country").agg(F.count("*").alias("n"), F.sum("n_authors").alias("n_authors"), F.round(F.avg(F.col("openaccess_flag").cast("double")) * 100, 2).alias("pct_open"), F.max("citedby_count").alias("max_cites"))


@query("""SELECT trove_category, trove_metadata_source, count(*) AS n_rows, count(DISTINCT trove_work_id) AS n_works, count(era_id) AS n_searched, count(*) FILTER (WHERE len(trove_isbns) > 0) AS n_isbn,
  count(*) FILTER (WHERE TRY_CAST(substr(regexp_replace(trove_issued, '^[^0-9]+', ''), 1, 4) AS INT) BETWEEN 2008 AND 2013) AS n_period FROM trove_title_candidates GROUP BY 1, 2""")
def harvest_profile(t):
    year = F.substring(F.regexp_replace("trove_issued", "^[^0-9]+", ""), 1, 4).try_cast("int")
    return t.trove.groupBy("trove_category", "trove_metadata_source").agg(F.count("*").alias("n_rows"), F.countDistinct("trove_work_id").alias("n_works"), F.count("era_id").alias("n_searched"), F.count_if(F.size("trove_isbns") > 0).alias("n_isbn"), F.count_if(year.between(2008, 2013)).alias("n_period"))


@query(f"""WITH k AS (SELECT research_output_type AS kind, count(*) AS n_rows, count(DISTINCT canonical_id) AS n_works, count(*) FILTER (WHERE n_submissions > 1) AS n_several FROM {W} GROUP BY 1),
a AS (SELECT kind, n_rows, n_works, n_several FROM k UNION ALL SELECT 'Total', CAST(sum(n_rows) AS BIGINT), CAST(sum(n_works) AS BIGINT), CAST(sum(n_several) AS BIGINT) FROM k)
SELECT *, round((n_rows - n_works) * 100.0 / n_rows, 2)::DOUBLE AS pct_repeated FROM a""")
def table_types(t):
    """Rows, works and repeats by type, with a total of the rows above it."""
    k = t.works.groupBy(F.col("research_output_type").alias("kind")).agg(F.count("*").alias("n_rows"), F.countDistinct("canonical_id").alias("n_works"), F.count_if(F.col("n_submissions") > 1).alias("n_several"))
    total = k.agg(F.lit("Total").alias("kind"), *[F.sum(c).alias(c) for c in ("n_rows", "n_works", "n_several")])
    return k.unionByName(total).withColumn("pct_repeated", F.round((F.col("n_rows") - F.col("n_works")) * 100.0 / F.col("n_rows"), 2).cast("double"))


@query(f"SELECT code, count(*) AS n_rows, count(DISTINCT canonical_id) AS n_works FROM (SELECT canonical_id, unnest(title_provenance) AS code FROM {W}) GROUP BY 1")
def table_codes(t):
    return t.works.select("canonical_id", F.explode("title_provenance").alias("code")).groupBy("code").agg(F.count("*").alias("n_rows"), F.countDistinct("canonical_id").alias("n_works"))


@query(f"""WITH b AS (SELECT CASE WHEN n_submissions <= 5 THEN CAST(n_submissions AS VARCHAR) WHEN n_submissions <= 10 THEN '6-10' ELSE '11+' END AS bucket, min(n_submissions) AS o, count(*) AS n FROM {W} WHERE n_submissions >= 1 GROUP BY 1)
SELECT bucket, n, round(sum(n) OVER (ORDER BY o) * 100.0 / sum(n) OVER (), 2)::DOUBLE AS cumulative FROM b""")
def table_distribution(t):
    k = F.col("n_submissions")
    bucket = F.when(k <= 5, k.cast("string")).when(k <= 10, "6-10").otherwise("11+")
    b = t.works.filter(k >= 1).groupBy(bucket.alias("bucket")).agg(F.min(k).alias("o"), F.count("*").alias("n"))
    up, all_ = Window.partitionBy().orderBy("o").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # seven rows at most
    return b.select("bucket", "n", F.round(F.sum("n").over(up) * 100.0 / F.sum("n").over(all_), 2).cast("double").alias("cumulative"))


@query(f"""WITH g AS (SELECT research_output_type AS kind, trim(lower(title)) AS k, count(*) AS n, count(DISTINCT title) > 1 AS td, count(doi) < count(*) AND count(doi) > 0 AS om, count(DISTINCT lower(trim(doi))) > 1 AS dd, count(DISTINCT reference_year) > 1 AS yd, count(DISTINCT outlet) > 1 AS od FROM {W} WHERE title IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT kind, count(*) AS n_groups, count(*) FILTER (WHERE td) AS n_title, count(*) FILTER (WHERE om) AS n_omitted, count(*) FILTER (WHERE dd) AS n_doi, count(*) FILTER (WHERE yd) AS n_year, count(*) FILTER (WHERE od) AS n_outlet FROM g GROUP BY 1""")
def table_disparities(t):
    """How titles sent in more than once differ, by type."""
    d = F.countDistinct
    g = t.works.filter("title is not null").groupBy(F.col("research_output_type").alias("kind"), text.plain_title("title").alias("k")).agg(F.count("*").alias("n"), d("title").alias("t"), F.count("doi").alias("c"), d(F.lower(F.trim("doi"))).alias("d"), d("reference_year").alias("y"), d("outlet").alias("o")).filter("n > 1")
    count = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return g.groupBy("kind").agg(F.count("*").alias("n_groups"), count("t > 1", "n_title"), count("c < n AND c > 0", "n_omitted"), count("d > 1", "n_doi"), count("y > 1", "n_year"), count("o > 1", "n_outlet"))


@query(f"""WITH k AS (SELECT canonical_id, count(DISTINCT title) AS a, count(DISTINCT reference_year) AS b, count(*) AS n FROM {W} GROUP BY 1 HAVING count(DISTINCT delivered_by) > 1)
SELECT count(*) AS n_works, count(*) FILTER (WHERE a > 1) AS n_title, count(*) FILTER (WHERE b > 1) AS n_year, round(avg((a > 1 OR b > 1)::INT) * 100, 2) AS pct_any FROM k""")
def institutional_divergence(t):
    k = t.works.groupBy("canonical_id").agg(F.countDistinct("title").alias("a"), F.countDistinct("reference_year").alias("b"), F.countDistinct("delivered_by").alias("i")).filter("i > 1")
    return k.agg(F.count("*").alias("n_works"), F.count_if(F.col("a") > 1).alias("n_title"), F.count_if(F.col("b") > 1).alias("n_year"), F.round(F.avg(F.expr("a > 1 OR b > 1").cast("double")) * 100, 2).alias("pct_any"))


@query(f"""SELECT canonical_id, count(DISTINCT id) AS n_submissions, bool_or(eid IS NOT NULL) AS indexed FROM (SELECT canonical_id, unnest(source_ids) AS sid, lower(trim(doi)) AS d FROM {W}) JOIN era_research_outputs_raw ON id = sid LEFT JOIN scopus_shard ON d = doi_normalized GROUP BY 1""")
def provenance_bridge(t):
    ids = t.works.select("canonical_id", F.explode("source_ids").alias("id"), F.lower(F.trim("doi")).alias("doi_normalized")).distinct()
    s = ids.join(t.raw.select("id").distinct(), "id", "left_semi")
    i = t.index.filter("doi_normalized is not null").groupBy("doi_normalized").agg(F.bool_or(F.col("eid").isNotNull()).alias("has"))
    return s.join(i, "doi_normalized", "left").groupBy("canonical_id").agg(F.countDistinct("id").alias("n_submissions"), F.bool_or(F.coalesce("has", F.lit(False))).alias("indexed"))


@query("""WITH l AS (SELECT DISTINCT trove_work_id, nullif(trove_category, '') AS v, nullif(trove_metadata_source, '') AS s FROM trove_title_candidates)
SELECT trove_work_id, count(DISTINCT v) > 1 AS several_versions, count(DISTINCT s) > 1 AS several_sources, count(DISTINCT s) AS n_sources FROM l GROUP BY 1""")
def version_drift(t):
    """Drift over the locations of catalogue works: their categories and the sources that hold them."""
    loc = F.collect_set(F.struct(F.col("trove_category").alias("version"), F.col("trove_metadata_source").alias("source_name")))
    drift = t.trove.groupBy("trove_work_id").agg(loc.alias("l")).select("trove_work_id", disparity.version_drift(F.col("l")).alias("d"))
    return drift.select("trove_work_id", "d.several_versions", "d.several_sources", F.size("d.sources").cast("long").alias("n_sources"))
