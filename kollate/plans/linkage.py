"""Linkage of works to the index and the catalogue, their differences and coverage."""

from pyspark.sql import functions as F

from kollate.functions import text
from kollate.operators import disparity, link, resolve
from kollate.plans.registry import query

WORDS = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DOI = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '')"

#: One row per work: its first delivery by row_id.
WORKS = f"""works AS (
  SELECT canonical_id, first(title ORDER BY row_id) AS title, first(doi ORDER BY row_id) AS doi, first(doi_wellformed ORDER BY row_id) AS doi_wellformed,
    first(reference_year ORDER BY row_id) AS reference_year, first(research_output_type ORDER BY row_id) AS research_output_type, first(isbn ORDER BY row_id) AS isbn,
    first(outlet_isbn ORDER BY row_id) AS outlet_isbn, first(source_ids ORDER BY row_id) AS source_ids, first(institutions ORDER BY row_id) AS institutions
  FROM era_research_outputs_canonical GROUP BY canonical_id),
l AS (SELECT *, CASE WHEN doi_wellformed THEN {DOI.format('doi')} END AS dk, {WORDS.format('title')} AS tk FROM works)"""
_COLUMNS = ["title", "doi", "doi_wellformed", "reference_year", "research_output_type", "isbn", "outlet_isbn", "source_ids", "institutions"]


def works(t):
    firsts = t.works.groupBy("canonical_id").agg(F.min_by(F.struct(*_COLUMNS), "row_id").alias("f"))
    return firsts.select("canonical_id", "f.*")


_INDEX = f"""r AS (SELECT eid, min(title) AS ititle, min(lower(trim(doi_normalized))) AS idoi, min({WORDS.format('title')}) AS itk FROM scopus_shard WHERE status = 'ok' AND eid IS NOT NULL GROUP BY eid)"""
_LINK = f"""WITH {WORKS}, {_INDEX},
t1 AS (SELECT canonical_id, eid FROM (SELECT canonical_id, eid, row_number() OVER (PARTITION BY canonical_id ORDER BY
    CASE WHEN tk = itk THEN 1 WHEN length(itk) > 0 AND (contains(tk, itk) OR contains(itk, tk)) THEN 2 ELSE 3 END, eid) AS n FROM l JOIN r ON dk = idoi) WHERE n = 1),
u AS (SELECT itk, min(eid) AS eid FROM r WHERE length(itk) >= 15 GROUP BY itk HAVING count(DISTINCT eid) = 1),
t2 AS (SELECT canonical_id, u.eid FROM l JOIN u ON tk = itk WHERE canonical_id NOT IN (SELECT canonical_id FROM t1)),
m AS (SELECT canonical_id, eid, 'doi' AS match_tier FROM t1 UNION ALL SELECT canonical_id, eid, 'title' FROM t2)"""


def index_links(t):
    """(canonical_id, eid, match_tier) of works in the index: by DOI, best title first, else by a title one record alone has."""
    left = works(t).select("canonical_id", F.when(F.col("doi_wellformed"), text.doi("doi")).alias("dk"), text.title_words("title").alias("tk"))
    right = t.index.filter("status = 'ok' AND eid IS NOT NULL").groupBy("eid").agg(F.min(F.lower(F.trim("doi_normalized"))).alias("idoi"), F.min(text.title_words("title")).alias("itk"))
    contained = (F.length("itk") > 0) & (F.contains(F.col("tk"), F.col("itk")) | F.contains(F.col("itk"), F.col("tk")))
    rank = F.when(F.col("tk") == F.col("itk"), 1).when(contained, 2).otherwise(3)
    long_enough = lambda c: F.when(F.length(c) >= 15, F.col(c))
    tiers = [link.Tier("doi", F.col("dk"), F.col("idoi"), order=[rank]), link.Tier("title", long_enough("tk"), long_enough("itk"), unique=True)]
    return link.link(left, right, "canonical_id", "eid", tiers)


@query(f"{_LINK} SELECT canonical_id, eid, match_tier FROM m")
def index_linkage(t):
    return index_links(t)


@query(f"{_LINK} SELECT coalesce(match_tier, 'none') AS match_tier, count(*) AS n_works, count(DISTINCT eid) AS n_records FROM l LEFT JOIN m USING (canonical_id) GROUP BY 1")
def linkage_tiers(t):
    joined = works(t).select("canonical_id").join(index_links(t), "canonical_id", "left")
    return joined.groupBy(F.coalesce("match_tier", F.lit("none")).alias("match_tier")).agg(F.count("*").alias("n_works"), F.countDistinct("eid").alias("n_records"))


# The title rules in SQL, with nothing to unescape.
def label_sql(a: str, b: str, subtitle_first: bool) -> str:
    to, signs = ("''", r"[^\w\s]") if subtitle_first else ("' '", r"[^a-zA-Z0-9\s]")
    plain = lambda c: f"lower(trim(regexp_replace(regexp_replace({c}, '{signs}', {to}, 'g'), '\\s+', ' ', 'g')))"
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    short, long_ = f"(CASE WHEN length({x}) < length({y}) THEN {x} ELSE {y} END)", f"(CASE WHEN length({x}) < length({y}) THEN {y} ELSE {x} END)"
    marks = " OR ".join(f"starts_with({long_}, {short} || '{m}') OR trim(split_part({long_}, '{m.strip()}', 1)) = {short}" for m in (":", " -", " --", " —", " /"))
    crop = f"WHEN {x} <> {y} AND ({marks}) THEN 'cropped_subtitle'"
    punct = f"WHEN {plain(a)} = {plain(b)} THEN 'punctuation_or_case'"
    p, q = plain(a), plain(b)
    s2, l2 = f"(CASE WHEN length({p}) < length({q}) THEN {p} ELSE {q} END)", f"(CASE WHEN length({p}) < length({q}) THEN {q} ELSE {p} END)"
    indel = f"WHEN abs(length({p}) - length({q})) = 1 AND list_bool_or(list_transform(range(1, length({l2}) + 1), lambda i: substr({l2}, 1, i - 1) || substr({l2}, i + 1) = {s2})) THEN 'spelling_indel'"
    jac = f"len(list_intersect(string_split({p}, ' '), string_split({q}, ' '))) / len(list_distinct(list_concat(string_split({p}, ' '), string_split({q}, ' ')))) < 0.25"
    order = f"{crop} {punct}" if subtitle_first else f"{punct} {crop}"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN 'omitted' WHEN {a} = {b} THEN 'exact' {order} {indel} WHEN length({p}) > 0 AND length({q}) > 0 AND {jac} THEN 'discordant' ELSE 'typographical_variant' END"


#: Unicode letters differ between the engines' \w; the SQL covers pairs of ASCII titles, which queries of their own give; brute force in the tests covers all.
_ASCII = "regexp_full_match(coalesce(title, ''), '[ -~]*') AND regexp_full_match(coalesce(ititle, ''), '[ -~]*')"


def ascii_titles(rows):
    ascii_ = lambda c: F.coalesce(c, F.lit("")).rlike("^[ -~]*$")
    return rows.filter(ascii_("title") & ascii_("ititle"))


def title_pairs(t):
    linked = index_links(t).join(works(t).select("canonical_id", "title"), "canonical_id")
    titles = t.index.filter("status = 'ok'").groupBy("eid").agg(F.min("title").alias("ititle"))
    return linked.join(titles, "eid")


@query(f"{_LINK}, p AS (SELECT canonical_id, title, ititle FROM m JOIN l USING (canonical_id) JOIN r USING (eid)) SELECT label, count(*) AS n FROM (SELECT {label_sql('title', 'ititle', False)} AS label FROM p WHERE {_ASCII}) GROUP BY 1")
def index_title_labels_ascii(t):
    return index_labels(ascii_titles(title_pairs(t)))


def index_labels(pairs):
    return pairs.select(disparity.title(F.col("title"), F.col("ititle"), subtitle_first=False).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query()
def index_title_labels(t):
    return index_labels(title_pairs(t))


@query(f"""WITH d AS (SELECT canonical_id, row_id, title, first_value(title) OVER (PARTITION BY canonical_id ORDER BY row_id) AS ititle FROM era_research_outputs_canonical)
SELECT row_id, {label_sql('title', 'ititle', True)} AS label FROM d WHERE {_ASCII}""")
def delivery_title_labels_ascii(t):
    return delivery_labels(ascii_titles(deliveries(t)))


def deliveries(t):
    first = t.works.groupBy("canonical_id").agg(F.min_by("title", "row_id").alias("ititle"))
    return t.works.join(first, "canonical_id")


def delivery_labels(pairs):
    return pairs.select("row_id", disparity.title(F.col("title"), F.col("ititle")).alias("label"))


@query()
def delivery_title_labels(t):
    """Each delivery's title against the work's first one."""
    return delivery_labels(deliveries(t))


_PROFILE = """CASE WHEN y AND d AND NOT tt THEN 'coupled_lifecycle_drift' WHEN y AND d THEN 'coupled_with_title_disp' WHEN tt AND y THEN 'title_and_year_disp' WHEN tt AND d THEN 'title_and_doi_disp'
  WHEN tt THEN 'isolated_title_disp' WHEN y THEN 'isolated_year_disp' WHEN d THEN 'isolated_doi_disp' ELSE 'clean' END"""


@query(f"""WITH f AS (SELECT canonical_id, title, doi, reference_year, first_value(title) OVER w AS ft, first_value(doi) OVER w AS fd, first_value(reference_year) OVER w AS fy FROM era_research_outputs_canonical WINDOW w AS (PARTITION BY canonical_id ORDER BY row_id)),
g AS (SELECT title IS DISTINCT FROM ft AS tt, abs(reference_year - fy) AS gap, {DOI.format('doi')} AS x, {DOI.format('fd')} AS z FROM f),
h AS (SELECT tt, coalesce(gap > 0, FALSE) AS y, NOT (x IS NULL AND z IS NULL) AND (x IS NULL OR z IS NULL OR x <> z) AS d FROM g),
k AS (SELECT {_PROFILE} AS profile, y AND d AS coupled FROM h)
SELECT profile, coupled, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS share FROM k GROUP BY 1, 2""")
def delivery_profiles(t):
    """Profiles of deliveries against the work's first one, with their share of all."""
    first = t.works.groupBy("canonical_id").agg(F.min_by(F.struct("title", "doi", "reference_year"), "row_id").alias("f"))
    joined = t.works.join(first, "canonical_id")
    gap = disparity.year_gap(F.col("reference_year"), F.col("f.reference_year"))
    doi = disparity.doi_label(F.col("doi"), F.col("f.doi")).isin("omitted", "discordant")
    kinds = joined.select(disparity.profile(~F.col("title").eqNullSafe(F.col("f.title")), gap, doi).alias("profile"), disparity.coupled(gap, doi).alias("coupled"))
    counted = kinds.groupBy("profile", "coupled").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))  # one row
    return counted.join(F.broadcast(total)).select("profile", "coupled", "n", F.round(F.col("n") * 100.0 / F.col("all"), 2).cast("double").alias("share"))


_DLABEL = "CASE WHEN x IS NULL AND z IS NULL THEN 'both_missing' WHEN x IS NULL OR z IS NULL THEN 'omitted' WHEN x = z THEN 'exact' ELSE 'discordant' END"


@query(f"""WITH {WORKS}, s AS (SELECT id, first(doi ORDER BY submitted_at, institution, title, doi) AS rd, first(reference_year ORDER BY submitted_at, institution, title, doi) AS ry FROM era_research_outputs_raw GROUP BY id),
p AS (SELECT {DOI.format('doi')} AS x, {DOI.format('rd')} AS z, abs(reference_year - ry) AS gap FROM works JOIN s ON id = canonical_id)
SELECT {_DLABEL} AS doi_label, CASE WHEN gap IS NULL THEN 'E' WHEN gap = 0 THEN '' ELSE 'T' END AS year_code, count(*) AS n FROM p GROUP BY 1, 2""")
def submission_differences(t):
    first = t.raw.groupBy("id").agg(F.min_by(F.struct("doi", "reference_year"), F.struct(F.coalesce(F.col("submitted_at").isNull(), F.lit(True)), "submitted_at", F.col("institution").isNull(), "institution", F.col("title").isNull(), "title", F.col("doi").isNull(), "doi")).alias("s"))
    joined = works(t).join(first, F.col("id") == F.col("canonical_id"))
    return joined.select(disparity.doi_label(F.col("doi"), F.col("s.doi")).alias("doi_label"), F.array_join(disparity.year_codes(F.col("reference_year"), F.col("s.reference_year")), ",").alias("year_code")).groupBy("doi_label", "year_code").agg(F.count("*").alias("n"))


_NUM = "CASE WHEN length(nullif(upper(regexp_replace({0}, '[^0-9Xx]', '', 'g')), '')) IN (10, 13) THEN upper(regexp_replace({0}, '[^0-9Xx]', '', 'g')) END"
_TROVE = f"""WITH {WORKS},
c AS (SELECT trove_work_id, min(trove_title) AS ttitle, min({WORDS.format('trove_title')}) AS ck, min(TRY_CAST(nullif(regexp_extract(trove_issued, '[0-9]{{4}}', 0), '') AS INT)) AS cy, min(trove_rank) AS rank FROM trove_title_candidates GROUP BY trove_work_id),
cn AS (SELECT DISTINCT trove_work_id, {_NUM.format('i')} AS n FROM (SELECT trove_work_id, unnest(trove_isbns) AS i FROM trove_title_candidates)),
wn AS (SELECT canonical_id, reference_year, coalesce({_NUM.format('isbn')}, {_NUM.format('outlet_isbn')}) AS n FROM works),
b1 AS (SELECT canonical_id, min(trove_work_id) AS trove_work_id FROM wn JOIN cn USING (n) GROUP BY 1),
b2 AS (SELECT canonical_id, trove_work_id FROM (SELECT canonical_id, trove_work_id, row_number() OVER (PARTITION BY canonical_id ORDER BY -(100 + CASE WHEN coalesce(abs(reference_year - cy) <= 1, FALSE) THEN 20 ELSE 0 END - 5 * coalesce(rank, 0)), trove_work_id) AS k
  FROM l JOIN c ON tk = ck WHERE length(tk) >= 15 AND canonical_id NOT IN (SELECT canonical_id FROM b1)) WHERE k = 1),
x AS (SELECT canonical_id, trove_work_id, 'isbn' AS match_tier FROM b1 UNION ALL SELECT canonical_id, trove_work_id, 'title_candidate' FROM b2)"""


def catalogue_links(t):
    """(canonical_id, trove_work_id, match_tier): by ISBN, else by title, the best score of year and rank first."""
    left = works(t).select("canonical_id", "reference_year", F.when(F.length(text.title_words("title")) >= 15, text.title_words("title")).alias("tk"), F.coalesce(text.isbn("isbn"), text.isbn("outlet_isbn")).alias("n"))
    c = t.trove.groupBy("trove_work_id").agg(F.min(text.title_words("trove_title")).alias("ck"), F.min(text.year_in("trove_issued")).alias("cy"), F.min("trove_rank").alias("rank"))
    numbers = t.trove.select("trove_work_id", F.explode("trove_isbns").alias("i")).select("trove_work_id", text.isbn("i").alias("cn")).dropna().distinct()
    by_isbn = link.link(left, numbers, "canonical_id", "trove_work_id", [link.Tier("isbn", F.col("n"), F.col("cn"))])
    rest = left.join(by_isbn.select("canonical_id"), "canonical_id", "left_anti")
    score = text.candidate_score(F.lit(True), F.abs(F.col("reference_year") - F.col("cy")) <= 1, F.col("rank"))
    by_title = link.link(rest, c, "canonical_id", "trove_work_id", [link.Tier("title_candidate", F.col("tk"), F.col("ck"), order=[-score])])
    return by_isbn.unionByName(by_title)


@query(f"{_TROVE} SELECT * FROM x")
def catalogue_linkage(t):
    return catalogue_links(t)


@query(f"""WITH {WORKS}, e AS (SELECT canonical_id, unnest(source_ids) AS era_id FROM works),
p AS (SELECT e.canonical_id, trove_work_id, trove_rank FROM e JOIN trove_title_candidates USING (era_id))
SELECT canonical_id, count(DISTINCT trove_work_id) AS n_candidates, min(trove_rank) AS best_rank FROM p GROUP BY 1""")
def candidates_by_submission(t):
    ids = works(t).select("canonical_id", F.explode("source_ids").alias("era_id"))
    return ids.join(t.trove.filter("era_id is not null"), "era_id").groupBy("canonical_id").agg(F.countDistinct("trove_work_id").alias("n_candidates"), F.min("trove_rank").alias("best_rank"))


_SYN = """, oa AS (SELECT canonical_id, count(DISTINCT institution) > 1 AS shared FROM (SELECT canonical_id, unnest(institutions) AS institution FROM works) GROUP BY 1),
syn AS (SELECT w.canonical_id, research_output_type, coalesce(shared, FALSE) AS in_shared, m.eid IS NOT NULL AS in_index, x.trove_work_id IS NOT NULL AS in_catalogue
  FROM works w LEFT JOIN oa USING (canonical_id) LEFT JOIN m USING (canonical_id) LEFT JOIN x USING (canonical_id)),
cov AS (SELECT *, CAST(in_shared AS INT) + CAST(in_index AS INT) + CAST(in_catalogue AS INT) AS n,
  CASE WHEN in_shared AND in_index AND in_catalogue THEN 'All Three' WHEN in_shared AND in_index THEN 'Shared & Index' WHEN in_shared AND in_catalogue THEN 'Shared & Catalogue' WHEN in_index AND in_catalogue THEN 'Index & Catalogue'
    WHEN in_shared THEN 'Shared Only' WHEN in_index THEN 'Index Only' WHEN in_catalogue THEN 'Catalogue Only' ELSE 'None' END AS category FROM syn)"""
_BOTH = _LINK + ", " + _TROVE[_TROVE.index("c AS ("):] + _SYN


def synthesis(t):
    """One row per work with a flag for each source; a work without a row in a source isn't in it."""
    w = works(t).select("canonical_id", "research_output_type", (F.size(F.array_distinct("institutions")) > 1).alias("in_shared"))
    w = w.join(index_links(t).select("canonical_id", F.lit(True).alias("i")), "canonical_id", "left").join(catalogue_links(t).select("canonical_id", F.lit(True).alias("c")), "canonical_id", "left")
    false = F.lit(False)
    w = w.select("canonical_id", "research_output_type", F.coalesce("in_shared", false).alias("in_shared"), F.coalesce("i", false).alias("in_index"), F.coalesce("c", false).alias("in_catalogue"))
    return w.withColumn("category", coverage(["in_shared", "in_index", "in_catalogue"], ["Shared", "Index", "Catalogue"]))


def coverage(flags: list[str], names: list[str]):
    """The combination of three flags in words."""
    a, b, c = map(F.col, flags)
    x, y, z = names
    return (
        F.when(a & b & c, "All Three").when(a & b, f"{x} & {y}").when(a & c, f"{x} & {z}").when(b & c, f"{y} & {z}")
        .when(a, f"{x} Only").when(b, f"{y} Only").when(c, f"{z} Only").otherwise("None")
    )


@query(f"{_BOTH} SELECT coalesce(research_output_type, 'Unknown') AS output_type, count(*) AS n, count(*) FILTER (WHERE in_index) AS n_index, round(count(*) FILTER (WHERE in_index) * 100.0 / count(*), 1)::DOUBLE AS pct_index, count(*) FILTER (WHERE in_catalogue) AS n_catalogue, round(count(*) FILTER (WHERE in_catalogue) * 100.0 / count(*), 1)::DOUBLE AS pct_catalogue, count(*) FILTER (WHERE n > 0) AS n_any, count(*) FILTER (WHERE category = 'None') AS n_none FROM cov GROUP BY 1")
def coverage_by_type(t):
    s = synthesis(t)
    pct = lambda c: F.round(F.count_if(F.col(c)) * 100.0 / F.count("*"), 1).cast("double")
    return s.groupBy(F.coalesce("research_output_type", F.lit("Unknown")).alias("output_type")).agg(F.count("*").alias("n"), F.count_if("in_index").alias("n_index"), pct("in_index").alias("pct_index"), F.count_if("in_catalogue").alias("n_catalogue"), pct("in_catalogue").alias("pct_catalogue"), F.count_if(F.col("category") != "None").alias("n_any"), F.count_if(F.col("category") == "None").alias("n_none"))


@query(f"{_BOTH} SELECT category, count(*) AS work_count, round(count(*) * 100.0 / (SELECT count(*) FROM cov), 2)::DOUBLE AS pct_total, count(*) FILTER (WHERE research_output_type = 'Journal Article') AS n_articles, count(*) FILTER (WHERE research_output_type IN ('Book', 'Book Chapter')) AS n_books FROM cov GROUP BY 1")
def coverage_intersections(t):
    s = synthesis(t).groupBy("category").agg(F.count("*").alias("work_count"), F.count_if(F.col("research_output_type") == "Journal Article").alias("n_articles"), F.count_if(F.col("research_output_type").isin("Book", "Book Chapter")).alias("n_books"))
    total = s.agg(F.sum("work_count").alias("all"))  # one row
    return s.join(F.broadcast(total)).select("category", "work_count", F.round(F.col("work_count") * 100.0 / F.col("all"), 2).cast("double").alias("pct_total"), "n_articles", "n_books")


@query(f"""WITH {WORKS}, a AS (SELECT DISTINCT regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g') AS k FROM works), b AS (SELECT DISTINCT regexp_replace(lower(trim(trove_title)), '[^a-z0-9]', '', 'g') AS j FROM trove_title_candidates)
SELECT k, j FROM a JOIN b ON substr(k, 1, 15) = substr(j, 1, 15) WHERE length(k) >= 15 AND length(j) >= 15 AND (starts_with(k, j) OR starts_with(j, k))""")
def prefix_titles(t):
    a = works(t).select(text.title_key("title").alias("k")).distinct()
    b = t.trove.select(text.title_key("trove_title").alias("j")).distinct()
    return link.prefix_pairs(a, b, "k", "j").select("k", "j")


def close_titles(t, least):
    a = works(t).select(text.title_key("title").alias("k")).filter("length(k) >= 10").distinct()
    b = t.trove.select(text.title_key("trove_title").alias("j")).filter("length(j) >= 10").distinct()
    return link.fuzzy_pairs(a, b, "k", "j", least).select("k", "j", F.round("similarity", 6).alias("similarity"))


@query()
def fuzzy_titles(t):
    return close_titles(t, 0.9)


@query(f"""WITH {WORKS}, a AS (SELECT DISTINCT regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g') AS k FROM works), b AS (SELECT DISTINCT regexp_replace(lower(trim(trove_title)), '[^a-z0-9]', '', 'g') AS j FROM trove_title_candidates)
SELECT k, j, round(jaro_winkler_similarity(k, j), 6) AS similarity FROM a JOIN b ON substr(k, 1, 10) = substr(j, 1, 10) WHERE length(k) >= 10 AND length(j) >= 10 AND jaro_winkler_similarity(k, j) >= 0.97""")
def fuzzy_titles_close(t):
    """The part of them that the SQL covers."""
    return close_titles(t, 0.97)


@query(f"""{_TROVE}, o AS (SELECT l.canonical_id, CASE WHEN x.match_tier IS NOT NULL THEN x.match_tier WHEN EXISTS (SELECT 1 FROM c WHERE substr(ck, 1, 15) = substr(tk, 1, 15) AND length(tk) >= 15 AND length(ck) >= 15 AND (starts_with(ck, tk) OR starts_with(tk, ck))) THEN 'prefix' ELSE 'none' END AS tier FROM l LEFT JOIN x USING (canonical_id))
SELECT tier, count(*) AS n FROM o GROUP BY 1""")
def overlap_partition_strict(t):
    """The partition without the fuzzy tier, which the SQL checks."""
    return partition(t, fuzzy=False)


@query()
def overlap_partition(t):
    """Works by the first tier that finds them in the catalogue; each tier sees only what is left."""
    return partition(t, fuzzy=True)


def partition(t, fuzzy):
    w = works(t).select("canonical_id", text.title_words("title").alias("tk"), text.title_key("title").alias("k"))
    found = catalogue_links(t).select("canonical_id", F.col("match_tier").alias("tier"))
    rest = w.join(found, "canonical_id", "left_anti")
    c = t.trove.groupBy("trove_work_id").agg(F.min(text.title_words("trove_title")).alias("ck")).select("ck").distinct()
    by_prefix = link.prefix_pairs(rest, c, "tk", "ck").select("canonical_id", F.lit("prefix").alias("tier")).distinct()
    found = found.unionByName(by_prefix)
    if fuzzy:
        rest = rest.join(by_prefix, "canonical_id", "left_anti").select("canonical_id", "k").filter("length(k) > 15")
        j = t.trove.select(text.title_key("trove_title").alias("j")).filter("length(j) > 15").distinct()
        found = found.unionByName(link.fuzzy_pairs(rest, j, "k", "j", 0.9).select("canonical_id", F.lit("fuzzy").alias("tier")).distinct())
    all_ = w.select("canonical_id").join(found, "canonical_id", "left")
    return all_.groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT research_output_type, trim(lower(title)) AS norm_title, count(*) AS n_records, count(DISTINCT institution) AS n_institutions, min(id) AS first_id FROM era_research_outputs_raw WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1, 2)
SELECT * FROM g WHERE n_institutions > 1""")
def cross_institution_duplicates(t):
    return resolve.duplicate_groups(t.raw, "research_output_type", "title", "institution", "id")


@query("""WITH g AS (SELECT institution, trim(lower(title)) AS norm_title, count(DISTINCT id) AS n FROM era_research_outputs_raw WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)
SELECT institution, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_records FROM g GROUP BY 1""")
def same_institution_duplicates(t):
    g = t.raw.filter(text.present("title")).groupBy("institution", text.plain_title("title").alias("norm_title")).agg(F.countDistinct("id").alias("n")).filter("n > 1")
    return g.groupBy("institution").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_records"))


_RAW = f"""s AS (SELECT id, first(title ORDER BY submitted_at, institution, title, doi) AS title, first(doi ORDER BY submitted_at, institution, title, doi) AS doi, first(research_output_type ORDER BY submitted_at, institution, title, doi) AS kind FROM era_research_outputs_raw GROUP BY id),
n AS (SELECT id, kind, lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS t, {DOI.format('doi')} AS d FROM s),
v AS (SELECT *, regexp_full_match(coalesce(d, ''), '10\\.\\d{{4,}}(\\.\\d+)*/\\S+') AS ok FROM n)"""


def submissions(t):
    """One row per submission, its first by time."""
    order = F.struct(*[x for c in ("submitted_at", "institution", "title", "doi") for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])
    first = t.raw.groupBy("id").agg(F.min_by(F.struct("title", "doi", "research_output_type", "institution", "reference_year", "outlet"), order).alias("s")).select("id", "s.*")
    d = text.doi("doi")
    return first.select("id", F.col("research_output_type").alias("kind"), "title", "institution", "reference_year", "outlet", d.alias("doi"), F.coalesce(d.rlike(r"^10\.\d{4,}(\.\d+)*/\S+$"), F.lit(False)).alias("doi_wellformed"), F.lit(None).cast("string").alias("identifier"), F.lit(False).alias("identifier_wellformed"))


_TIES = f"""WITH RECURSIVE {_RAW},
clear AS (SELECT kind, t FROM v WHERE t IS NOT NULL AND len(regexp_split_to_array(t, '\\s+')) >= 2 GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN ok THEN d END) <= 1),
keyed AS (SELECT id, 'd' || d AS k FROM v WHERE ok UNION ALL SELECT id, 't' || coalesce(v.kind, '') || '|' || v.t FROM v JOIN clear c ON v.t = c.t AND v.kind IS NOT DISTINCT FROM c.kind),
star AS (SELECT DISTINCT id AS b, min(id) OVER (PARTITION BY k) AS a FROM keyed),
both_ways AS (SELECT a, b FROM star WHERE a < b UNION SELECT b, a FROM star WHERE a < b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT s.id, coalesce(g, s.id) AS component FROM s LEFT JOIN (SELECT a, min(b) AS g FROM reach GROUP BY a) ON s.id = a)"""


def clustered(t):
    s = submissions(t)
    return s.join(resolve.components(s, "id", resolve.submission_ties(s)), "id")


@query(f"{_TIES} SELECT id, component FROM comp")
def submission_clusters(t):
    return clustered(t).select("id", "component")


@query(f"""{_TIES}, j AS (SELECT component, s.* , {DOI.format('doi')} AS nd FROM comp JOIN s USING (id)),
tc AS (SELECT component, title, count(*) AS n, min(id) AS p FROM j WHERE title IS NOT NULL GROUP BY 1, 2),
tb AS (SELECT component, first(title ORDER BY n DESC, length(title) DESC, p) AS title FROM tc GROUP BY 1)
SELECT component AS canonical_id, count(*) AS n_submissions, any_value(tb.title) AS title, count(DISTINCT nd) > 1 AND count(DISTINCT CASE WHEN regexp_full_match(coalesce(nd, ''), '10\\.\\d{{4,}}(\\.\\d+)*/\\S+') THEN nd END) > 1 AS doi_differs
FROM j LEFT JOIN tb USING (component) GROUP BY component""")
def golden_records(t):
    return resolve.canonical(clustered(t)).select("canonical_id", "n_submissions", "title", "doi_differs")


@query("""WITH d AS (SELECT DISTINCT outlet FROM era_research_outputs_canonical WHERE outlet IS NOT NULL), s AS (SELECT outlet AS s FROM d WHERE length(outlet) = 61), w AS (SELECT outlet AS w FROM d WHERE length(outlet) <> 61),
f AS (SELECT s, min(w) AS one FROM s JOIN w ON starts_with(w, s) GROUP BY s HAVING count(*) = 1)
SELECT row_id, coalesce(one, outlet) AS repaired, CASE WHEN length(outlet) = 61 THEN 'F' END AS cut FROM era_research_outputs_canonical LEFT JOIN f ON outlet = s""")
def outlets_repaired(t):
    return resolve.repair_truncated(t.works.select("row_id", "outlet"), "outlet", "outlet", 61).select("row_id", "repaired", "cut")


_INSIDE = "list_bool_or(list_transform(range(1, length(b) + 1), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = a))"


@query(f"""WITH t AS (SELECT canonical_id AS g, title, count(*) AS n FROM era_research_outputs_canonical WHERE title IS NOT NULL GROUP BY 1, 2), p AS (SELECT x.g, x.title AS a, y.title AS b, y.n FROM t x JOIN t y ON x.g = y.g AND length(y.title) = length(x.title) + 1),
q AS (SELECT g, a, first(b ORDER BY n DESC, b) AS b FROM p WHERE {_INSIDE} GROUP BY 1, 2), s AS (SELECT *, substr(b, list_max(list_filter(range(0, length(b)), lambda k: substr(a, 1, k) = substr(b, 1, k))) + 1, 1) AS sign FROM q)
SELECT row_id, title, b AS repaired, CASE WHEN regexp_matches(sign, '\\s') THEN 'K' WHEN regexp_matches(sign, '[\\p{{L}}\\p{{N}}]') THEN 'B' ELSE 'R' END AS indel FROM era_research_outputs_canonical JOIN s ON canonical_id = g AND title = a""")
def titles_repaired(t):
    return resolve.repair_indels(t.works.select("row_id", "canonical_id", "title"), "canonical_id", "title").filter("indel is not null").select("row_id", "title", "repaired", "indel")
