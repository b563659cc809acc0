"""Reading of nested API responses, XML and line files into flat tables with fixed schemas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kollate.functions import text
from kollate.session import cut

RAW = "id long, type string, attributes struct<title: string, institution: string, `reference-year`: int, outlet: string, publisher: string, `other-details`: struct<isbn: string, issn: string, doi: string>>"


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submissions of a line file with nested, hyphenated names; unreadable lines are left out."""
    df = spark.read.schema(RAW).option("mode", "DROPMALFORMED").json(path)
    a = lambda name: F.col(f"attributes.`{name}`")
    d = lambda name: F.col(f"attributes.`other-details`.{name}")
    return df.select("id", F.col("type").alias("research_output_type"), a("title").alias("title"), a("institution").alias("institution"), a("reference-year").alias("reference_year"), a("outlet").alias("outlet"), a("publisher").alias("publisher"), d("doi").alias("doi"), d("isbn").alias("isbn"), d("issn").alias("issn"))


def join_keys(submissions: DataFrame) -> DataFrame:
    """Submissions with the normalised keys that linkage joins on."""
    return submissions.select("id", text.title_words("title").alias("title_normalized"), text.doi("doi").alias("doi_normalized"), text.number_key("isbn").alias("isbn_normalized"), text.number_key("issn").alias("issn_normalized"))


def read_many(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables of differing columns as one; missing columns are null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def ids_from_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, id) of a folder's files whose name begins with a number; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select("path")
    return files.select("path", F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).try_cast("long").alias("id"))


def completeness(rows: DataFrame, page: str, total: int) -> DataFrame:
    """(last_page, total_pages, complete) of a paged download."""
    return rows.agg(F.max(page).alias("last_page")).select("last_page", F.lit(total).alias("total_pages"), (F.col("last_page") >= total).alias("complete"))


# -- TEI ---------------------------------------------------------------------------------------------------------

_TEI = "{http://www.tei-c.org/ns/1.0}"
PAPERS = "paper string, title string, doi string, year string, n_references int"
REFERENCES = "paper string, bibl_id string, ref_title string, ref_authors string, ref_year string, ref_journal string, ref_doi string"
MENTIONS = "paper string, bibl_id string, section string"


def _words(el) -> str | None:
    found = " ".join("".join(el.itertext()).split()) if el is not None else ""
    return found or None


def _person(el) -> str:
    return " ".join(x for n in ("forename", "surname") for e in el.iter(_TEI + n) if (x := _words(e)))


def parse_tei(path: str, data: bytes) -> tuple[dict, list[dict], list[dict]] | None:
    """Paper, references and mentions of one document; None if it is no XML."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return None
    paper = re.sub(r"(\.grobid)?(\.tei)?\.xml$", "", path.rsplit("/", 1)[-1])
    refs = []
    for b in root.iter(_TEI + "biblStruct"):
        bid = b.get("{http://www.w3.org/XML/1998/namespace}id")
        if not bid:
            continue
        titles = {t.get("level"): _words(t) for t in b.iter(_TEI + "title")}
        date = next((d.get("when") for d in b.iter(_TEI + "date") if d.get("when")), None)
        doi = next((_words(i) for i in b.iter(_TEI + "idno") if (i.get("type") or "").lower() == "doi"), None)
        authors = "; ".join(filter(None, (_person(p) for p in b.iter(_TEI + "persName")))) or None
        refs.append({"paper": paper, "bibl_id": bid, "ref_title": titles.get("a") or titles.get("m") or titles.get("j"), "ref_authors": authors, "ref_year": date[:4] if date else None, "ref_journal": titles.get("j"), "ref_doi": doi})
    mentions = []
    for div in root.iter(_TEI + "div"):
        head = _words(div.find(_TEI + "head"))
        for r in div.iter(_TEI + "ref"):
            if r.get("type") == "bibr" and (r.get("target") or "").startswith("#"):
                mentions.append({"paper": paper, "bibl_id": r.get("target")[1:], "section": head})
    header = root.find(_TEI + "teiHeader")
    head = header if header is not None else root
    doi = next((_words(i) for i in head.iter(_TEI + "idno") if (i.get("type") or "").lower() == "doi"), None)
    year = next((d.get("when")[:4] for d in head.iter(_TEI + "date") if d.get("when")), None)
    return {"paper": paper, "title": _words(next(head.iter(_TEI + "title"), None)), "doi": doi, "year": year, "n_references": len(refs)}, refs, mentions


def read_tei(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, references and mentions of (path, content); documents that are no XML are left out. Each document is parsed once."""
    schema = f"paper struct<{_struct(PAPERS)}>, refs array<struct<{_struct(REFERENCES)}>>, mentions array<struct<{_struct(MENTIONS)}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [f for p, c in zip(batch["path"], batch["content"]) if (f := parse_tei(p, bytes(c)))]
            yield pd.DataFrame(found, columns=["paper", "refs", "mentions"])

    parsed = cut(files.select("path", "content").mapInPandas(run, schema), "parsed")
    return parsed.select("paper.*"), parsed.select(F.inline("refs")), parsed.select(F.inline("mentions"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split() for x in ddl.split(", ")))


# -- API responses -----------------------------------------------------------------------------------------------

INDEX_DOCS = "array<struct<`prism:doi`: string, `dc:title`: string, eid: string, author_names: string, author_ids: string, citedby_count: string, openaccess: string, affilname: string, affiliation_country: string>>"


def index_rows(cache: DataFrame) -> DataFrame:
    """One row per record of cached answers (doi, payload), and a ``not_found`` row for a DOI without any."""
    docs = cache.select(text.doi("doi").alias("doi_normalized"), F.explode_outer(F.from_json("payload", INDEX_DOCS)).alias("d"))
    names = lambda c: F.filter(F.transform(F.split(c, ";"), F.trim), lambda x: x != "")
    return docs.select("doi_normalized", F.when(F.col("d.eid").isNotNull(), "ok").otherwise("not_found").alias("status"), F.col("d.`dc:title`").alias("title"), names(F.col("d.author_names")).alias("author_names"), names(F.col("d.author_ids")).alias("author_auids"), F.size(names(F.col("d.author_names"))).alias("n_authors"), F.col("d.citedby_count").try_cast("int").alias("citedby_count"), (F.col("d.openaccess") == "1").alias("openaccess_flag"), F.col("d.eid").alias("eid"), F.col("d.affilname").alias("affiliation_name"), F.col("d.affiliation_country").alias("affiliation_country")).distinct()


CATALOGUE = "array<struct<name: string, work: array<struct<id: string, url: string, title: string, issued: string, contributor: array<string>, isbn: array<string>>>>>"


def catalogue_candidates(cache: DataFrame) -> DataFrame:
    """Long candidates (era_id, category, rank, work) of cached answers (era_id, payload); ids without any keep one row."""
    kinds = cache.select("era_id", F.explode_outer(F.from_json("payload", CATALOGUE)).alias("c"))
    works = kinds.select("era_id", F.col("c.name").alias("trove_category"), F.posexplode_outer("c.work").alias("trove_rank", "w"))
    return works.select("era_id", F.when(F.col("w.id").isNotNull(), "ok").otherwise("not_found").alias("status"), "trove_category", "trove_rank", F.col("w.id").alias("trove_work_id"), F.col("w.url").alias("trove_url"), F.col("w.title").alias("trove_title"), F.col("w.issued").alias("trove_issued"), F.col("w.contributor").alias("trove_contributor"), F.col("w.isbn").alias("trove_isbns"))


def isbn_status(found: Column, has_edition: Column) -> Column:
    return F.when(~found, "not_found").when(has_edition, "ok").otherwise("edition_unresolved")


def harvest_ids(identifiers: Column) -> Column:
    """struct(doi, isbn, issn) of a list of struct(type, value): the last DOI, the first ISBN and ISSN."""
    of = lambda kind: F.filter(identifiers, lambda x: F.lower(x["type"]) == kind)
    dois = F.filter(F.transform(identifiers, lambda x: F.regexp_extract(x["value"], r"10\.\d{4,}/[^\s\"<>]+", 0)), lambda v: v != "")
    return F.struct(F.try_element_at(dois, F.lit(-1)).alias("doi"), F.try_element_at(of("isbn"), F.lit(1))["value"].alias("isbn"), F.try_element_at(of("issn"), F.lit(1))["value"].alias("issn"))


def portfolio_items(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, item_index, title) of nested items with a title."""
    items = rows.select(key, F.posexplode(F.from_json(payload, "array<struct<title: string>>")).alias("item_index", "i"))
    return items.select(key, "item_index", F.trim("i.title").alias("title")).filter("title <> ''")


def citation_counts(rows: DataFrame, payload: str) -> DataFrame:
    """Uid, title and the count of one database from nested citations; lines that can't be read are left out."""
    shape = "uid string, title string, citations array<struct<db: string, count: int>>"
    read = rows.select(F.from_json(payload, shape).alias("r")).filter("r.uid is not null")
    count = F.filter("r.citations", lambda c: c["db"] == "WOS")
    return read.select("r.uid", "r.title", F.try_element_at(count, F.lit(1))["count"].alias("n_citations"))


# -- nested works ------------------------------------------------------------------------------------------------


def authorships(works: DataFrame) -> DataFrame:
    """(work, author_rank, author) of works with nested authorships; ranks begin at 1."""
    a = works.select(text.digits_id("id").alias("work"), F.posexplode("authorships").alias("p", "a"))
    return a.select("work", (F.col("p") + 1).alias("author_rank"), "a.author_position", text.digits_id("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("author_name"), F.col("a.author.orcid").alias("orcid"), F.size(F.coalesce("a.institutions", F.array())).alias("n_institutions"))


def author_institutions(works: DataFrame) -> DataFrame:
    """(work, author_rank, institution_rank, institution) of the same, one row for each institution of an author."""
    a = works.select(text.digits_id("id").alias("work"), F.posexplode("authorships").alias("p", "a"))
    return a.select("work", (F.col("p") + 1).alias("author_rank"), F.posexplode("a.institutions").alias("q", "i")).select("work", "author_rank", (F.col("q") + 1).alias("institution_rank"), text.digits_id("i.id").alias("institution_id"), F.col("i.display_name").alias("institution_name"), F.col("i.country_code").alias("country_code"))


def locations(works: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Open locations of the wanted works: filtered by id before the nested list is opened."""
    w = works.withColumn("work", text.digits_id("id")).join(wanted.select(F.col(key).alias("work")).distinct(), "work", "left_semi")
    o = w.select("work", F.explode("locations").alias("l")).select("work", "l.is_oa", "l.pdf_url", "l.landing_page_url", F.col("l.source.display_name").alias("source_name"), F.col("l.source.type").alias("source_type"), "l.version")
    return o.filter(F.col("pdf_url").isNotNull() | F.col("landing_page_url").isNotNull())
