"""Scalar normalisers, cleaners, detectors and check digits over the domain tables."""

from pyspark.sql import functions as F

from kollate.functions import checksum, text
from kollate.functions.udfs import ascii_title, indel_code_exact, unescape
from kollate.operators import clean, detect
from kollate.plans.registry import query

WORDS = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DOI = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '')"
NUMBER = "nullif(upper(regexp_replace({0}, '[^0-9Xx]', '', 'g')), '')"
W = "era_research_outputs_canonical"


@query(f"""SELECT row_id, {WORDS.format('title')} AS words, regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g') AS key,
  regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') AS untagged, trim(lower(title)) AS plain,
  lower(trim(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g'))) AS reference FROM {W}""")
def title_keys(t):
    return t.works.select("row_id", text.title_words("title").alias("words"), text.title_key("title").alias("key"), text.untagged_title_key("title").alias("untagged"), text.plain_title("title").alias("plain"), text.reference_title_key("title").alias("reference"))


@query()
def title_keys_folded(t):
    return t.works.select("row_id", ascii_title("title").alias("ascii"), text.unicode_title_words("title").alias("words"), unescape("title").alias("unescaped"))


@query(f"SELECT row_id, {DOI.format('doi')} AS doi, doi_wellformed FROM {W}")
def doi_normalised(t):
    return t.works.select("row_id", text.doi("doi").alias("doi"), "doi_wellformed")


@query(f"""SELECT row_id, nullif(regexp_replace(lower(regexp_replace(doi, '^\\s+|\\s+$', '', 'g')), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*|doi\\s+)+', ''), '') AS doi FROM {W} WHERE doi IS NOT NULL""")
def doi_without_any_label(t):
    return t.works.filter("doi is not null").select("row_id", text.doi_any_labels("doi").alias("doi"))


@query(f"""SELECT row_id, {NUMBER.format('isbn')} AS number, CASE WHEN length({NUMBER.format('isbn')}) IN (10, 13) THEN {NUMBER.format('isbn')} END AS isbn,
  coalesce(regexp_replace(isbn, '[^0-9Xx]', '', 'g'), regexp_replace(outlet_isbn, '[^0-9Xx]', '', 'g')) AS key FROM {W}""")
def isbn_normalised(t):
    return t.works.select("row_id", text.number_key("isbn").alias("number"), text.isbn("isbn").alias("isbn"), text.isbn_or_outlet("isbn", "outlet_isbn").alias("key"))


_D13 = "list_sum(list_transform(range(1, 14), lambda i: CAST(substr(d, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0"
_D10 = "list_sum(list_transform(range(1, 11), lambda i: (CASE WHEN upper(substr(d, i, 1)) = 'X' THEN 10 ELSE CAST(substr(d, i, 1) AS INT) END) * (11 - i))) % 11 = 0"


@query(f"""WITH n AS (SELECT row_id, isbn, regexp_replace(isbn, '[-\\s]', '', 'g') AS d FROM {W} WHERE isbn IS NOT NULL)
SELECT row_id, CASE WHEN regexp_full_match(d, '[0-9]{{9}}[0-9Xx]') THEN {_D10} ELSE FALSE END AS isbn10,
  CASE WHEN regexp_full_match(d, '[0-9]{{13}}') THEN {_D13} ELSE FALSE END AS ean13 FROM n""")
def isbn_check_digits(t):
    return t.works.filter("isbn is not null").select("row_id", checksum.isbn10(F.col("isbn")).alias("isbn10"), checksum.ean13(F.col("isbn")).alias("ean13"))


@query(f"""WITH n AS (SELECT row_id, regexp_replace(isbn, '[^0-9]', '', 'g') AS x FROM {W}), d AS (SELECT row_id, substr(x, 1, 8) AS d FROM n WHERE length(x) >= 8)
SELECT row_id, (list_sum(list_transform(range(1, 8), lambda i: CAST(substr(d, i, 1) AS INT) * (9 - i))) + CAST(substr(d, 8, 1) AS INT)) % 11 = 0 AS good,
  (list_sum(list_transform(range(1, 8), lambda i: CAST(substr(d, i, 1) AS INT) * (9 - i))) + 10) % 11 = 0 AS ten FROM d""")
def issn_check_digits(t):
    """The first eight digits of book numbers as serial numbers: about one in eleven holds, as does one with the sign for ten."""
    digits = F.regexp_replace("isbn", "[^0-9]", "")
    rows = t.works.filter(F.length(digits) >= 8).select("row_id", F.concat(F.left(digits, F.lit(4)), F.lit("-"), F.substring(digits, 5, 3)).alias("s"), F.substring(digits, 8, 1).alias("last"))
    return rows.select("row_id", checksum.issn(F.concat("s", "last")).alias("good"), checksum.issn(F.concat("s", F.lit("X"))).alias("ten"))


_LOWDOI = "lower(doi)"
_OK = r"'10\.\d{{4,}}(\.\d+)*/\S+'".replace("{{", "{").replace("}}", "}")
_PRE = r"'^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)'"


@query(f"""WITH b AS (SELECT row_id, lower(doi) AS v FROM {W} WHERE doi IS NOT NULL),
c AS (SELECT *, regexp_replace(v, {_PRE}, '') AS s, trim(v) AS k, trim(regexp_replace(v, {_PRE}, '')) AS sk, regexp_full_match(v, {_OK}) AS fine FROM b),
d AS (SELECT *, regexp_full_match(sk, {_OK}) AS mended, regexp_full_match(s, {_OK}) AS by_s, regexp_full_match(k, {_OK}) AS by_k FROM c)
SELECT row_id, CASE WHEN fine THEN v ELSE sk END AS value, fine OR mended AS wellformed,
  concat_ws(',', CASE WHEN NOT fine AND mended AND NOT by_k THEN 'S' END, CASE WHEN NOT fine AND mended AND NOT by_s THEN 'K' END) AS codes FROM d""")
def clean_doi(t):
    cleaned = t.works.filter("doi is not null").select("row_id", clean.DOI.clean(F.col("doi")).alias("c"))
    return cleaned.select("row_id", "c.value", "c.wellformed", F.array_join("c.codes", ",").alias("codes"))


def _book(column: str) -> str:
    """Whether a text is a well-formed book number, for DuckDB."""
    d = f"regexp_replace({column}, '[-\\s]', '', 'g')"
    ten, thirteen = _D10.replace("d,", f"{d},"), _D13.replace("d,", f"{d},")
    return f"(CASE WHEN regexp_full_match({d}, '[0-9]{{9}}[0-9Xx]') THEN {ten} WHEN regexp_full_match({d}, '[0-9]{{13}}') THEN {thirteen} ELSE FALSE END)"


_SIGNS = "regexp_replace({0}, '[^0-9Xx-]', '', 'g')"


@query(f"""WITH n AS (SELECT row_id, isbn, trim(isbn) AS k, {_SIGNS.format('trim(isbn)')} AS m, {_SIGNS.format('isbn')} AS r FROM {W} WHERE isbn IS NOT NULL),
c AS (SELECT *, {_book('isbn')} AS fine, {_book('m')} AS mended, {_book('k')} AS by_k, {_book('r')} AS by_r FROM n)
SELECT row_id, CASE WHEN fine THEN isbn ELSE m END AS value, fine OR mended AS wellformed, concat_ws(',', CASE WHEN NOT fine AND mended AND NOT by_r THEN 'K' END, CASE WHEN NOT fine AND mended AND NOT by_k THEN 'R' END) AS codes FROM c""")
def clean_isbn(t):
    cleaned = t.works.filter("isbn is not null").select("row_id", clean.ISBN.clean(F.col("isbn")).alias("c"))
    return cleaned.select("row_id", "c.value", "c.wellformed", F.array_join("c.codes", ",").alias("codes"))


@query()
def clean_titles(t):
    cleaned = clean.free_text(t.works.select("row_id", "title"), "title", "c")
    return cleaned.select("row_id", "c.value", "c.wellformed", F.array_join("c.codes", ",").alias("codes"))


@query(f"""SELECT field, CASE WHEN v IS NULL OR length(trim(v)) = 0 OR lower(trim(v)) IN ('unknown', 'null', 'n/a', 'na', 'none', '-') THEN 'missing' ELSE 'present' END AS presence, count(*) AS n
FROM (SELECT 'title' AS field, title AS v FROM {W} UNION ALL SELECT 'outlet', outlet FROM {W} UNION ALL SELECT 'publisher', publisher FROM {W} UNION ALL SELECT 'doi', doi FROM {W}) GROUP BY 1, 2""")
def field_presence(t):
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("title", "outlet", "publisher", "doi")])
    return t.works.select(F.inline(fields)).groupBy("field", text.presence("v").alias("presence")).agg(F.count("*").alias("n"))


@query(f"""SELECT row_id, regexp_matches(title, '</?[a-zA-Z][a-zA-Z0-9]*\\s*/?>') AS html, regexp_matches(title, '\\\\[a-zA-Z]+') AS tex,
  regexp_matches(title, '\\b(color|behavior|center|organization|labor|analyze|modeling|fiber|program)\\b', 'i') AS us,
  regexp_matches(title, '\\b(colour|behaviour|centre|organisation|labour|analyse|modelling|fibre|programme)\\b', 'i') AS gb FROM {W} WHERE title IS NOT NULL""")
def title_signs(t):
    c = F.col("title")
    return t.works.filter("title is not null").select("row_id", detect.html_tag(c).alias("html"), detect.tex_command(c).alias("tex"), detect.dialect(c)["us"].alias("us"), detect.dialect(c)["gb"].alias("gb"))


@query("""SELECT doc_id, regexp_matches(text, '</?[a-zA-Z][a-zA-Z0-9]*\\s*/?>') AS html, regexp_matches(text, '\\\\[a-zA-Z]+') AS tex FROM documents WHERE text IS NOT NULL""")
def document_signs(t):
    c = F.col("text")
    return t.documents.filter("text is not null").select("doc_id", detect.html_tag(c).alias("html"), detect.tex_command(c).alias("tex"))


#: What stands between the years, sign by sign, for the oracle.
_BETWEEN = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""WITH r AS (SELECT row_id, regexp_extract(title, '(1[5-9][0-9][0-9]|20[0-4][0-9]){_BETWEEN}?{_BETWEEN}?[-‐‑‒–—―−_]?[-‐‑‒–—―−_]?{_BETWEEN}?{_BETWEEN}?(1[5-9][0-9][0-9]|20[0-4][0-9])', 0) AS x FROM {W} WHERE title IS NOT NULL)
SELECT row_id, CASE WHEN x = '' THEN NULL WHEN length(x) = 9 AND x[5] = '-' THEN 'valid' ELSE 'adjusted' END AS year_range FROM r""")
def title_year_range(t):
    return t.works.filter("title is not null").select("row_id", detect.year_range(F.col("title")).alias("year_range"))


@query(f"""SELECT row_id, regexp_matches(regexp_replace(title, '[\\p{{Latin}}\\p{{Common}}]', '', 'g'), '\\p{{L}}') AS non_latin FROM {W} WHERE title IS NOT NULL""")
def title_alphabet(t):
    return t.works.filter("title is not null").select("row_id", detect.non_latin(F.col("title")).alias("non_latin"))


@query()
def title_encoding_signs(t):
    return t.works.filter("title is not null").select("row_id", detect.read_as_latin(F.col("title")).alias("garbled"))


@query(f"""SELECT row_id, TRY_CAST(nullif(regexp_extract(CAST(reference_year AS VARCHAR), '[0-9]{{4}}', 0), '') AS INT) AS year, len(string_split(title, ' ')) AS words,
  lower(trim(regexp_replace(publisher, '^the\\s+', '', 'i'))) AS publisher, regexp_replace(lower(outlet), '[^a-z0-9]', '', 'g') AS outlet FROM {W} WHERE title IS NOT NULL""")
def small_scalars(t):
    return t.works.filter("title is not null").select("row_id", text.year_in(F.col("reference_year").cast("string")).alias("year"), text.word_count("title").cast("long").alias("words"), text.without_the(F.col("publisher")).alias("publisher"), F.lower(F.regexp_replace(F.lower("outlet"), "[^a-z0-9]", "")).alias("outlet"))


@query("""SELECT institution, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(institution_name)), '^the\\s+', ''), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS norm,
  regexp_matches(institution_name, '\\b(department|committee|group|team|university|institute|centre|center|commission|association|society|ministry|office|working party|consortium|taskforce|hospital|board|panel|australia|national|csiro|authority|division|faculty|school)\\b', 'i') AS corporate FROM era_institutions""")
def institution_names(t):
    return t.era_institutions.select("institution", text.institution("institution_name").alias("norm"), text.corporate("institution_name").alias("corporate"))


@query("""SELECT trove_work_id, trove_title, harvested_at, CAST(len(trove_contributor) AS BIGINT) AS listed, split_part(trove_contributor[1], ',', 1) AS family FROM trove_title_candidates""")
def contributor_names(t):
    first = F.try_element_at("trove_contributor", F.lit(1))
    family, _ = text.family_given(first)
    return t.trove.select("trove_work_id", "trove_title", "harvested_at", F.size("trove_contributor").cast("long").alias("listed"), family.alias("family"))


@query(f"""SELECT a.row_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda w: NOT list_contains(['the','a','an','and','or','of','in','on','at','to','for','with','by','as','is','are','was','were','from','that','this','between','into','through','after','before','using','study','analysis','role'], w)))) AS tokens FROM {W} a WHERE title IS NOT NULL""")
def content_words(t):
    return t.works.filter("title is not null").select("row_id", F.array_sort(text.content_tokens("title")).alias("tokens"))


@query()
def indels_by_blocks(t):
    """Pairs of a work's titles that one sign sets apart, by longest matching blocks."""
    titles = t.works.select("canonical_id", "title").dropna().distinct()
    a, b = titles.alias("a"), titles.alias("b")
    pairs = a.join(b, (F.col("a.canonical_id") == F.col("b.canonical_id")) & (F.length("a.title") + 1 == F.length("b.title")))
    return pairs.select("a.canonical_id", F.col("a.title").alias("short"), F.col("b.title").alias("long"), indel_code_exact("a.title", "b.title").alias("code")).filter("code is not null")
