"""Queries of the operators in this package, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kollate.llm import components, consensus, encode, lookalike, matching, mojibake, packing, truncation
from kollate.session import table

WORKS = "era_research_outputs_canonical"
FIELDS = ["title", "outlet", "publisher"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, WORKS), "row_id", "delivered_by", FIELDS).select("row_id", "field")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.shares(table(spark, folder, WORKS), "row_id", "delivered_by", FIELDS)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.work_groups(table(spark, folder, WORKS), table(spark, folder, "canonical_match_pairs"))


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    return matching.matched(table(spark, folder, WORKS), table(spark, folder, "trove_title_candidates"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder).select("canonical_id", "trove_work_id")


def p3_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.best_values(table(spark, folder, WORKS), table(spark, folder, "era_institutions"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each work in several rows: the surviving value of each field."""
    values = consensus.surviving(table(spark, folder, WORKS), table(spark, folder, "era_institutions"))
    wide = values.groupBy("work").pivot("field", ["title", "doi", "reference_year", "outlet"]).agg(F.max("value"))
    return wide.withColumnRenamed("work", "canonical_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restore(table(spark, folder, WORKS), "row_id", "title").select("row_id")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    found = mojibake.restore(table(spark, folder, WORKS), "row_id", "title")
    return found.select("row_id", "title", "restored", F.array_join("kinds", ",").alias("kinds"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(encode.token_counts(table(spark, folder, "documents")), table(spark, folder, "token_budgets"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p7_filling(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(_packed(spark, folder), table(spark, folder, "token_budgets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.read_alike(table(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.classes(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p2_found, p3_found, p3_confidence, p4_found, p4_records, p5_found, p5_restored, p6_ids, p7_containers, p7_filling, p8_found, p8_classes, p8_forms)}

#: The DOI without blanks and label, for DuckDB.
_DOI = r"regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|info:\s*doi/|urn:doi:|doi(?:\s*[:.=]\s*|\s+|/))+\s*', '')"

ORACLES = {
    "p2_found": rf"""
WITH RECURSIVE keyed AS (
  SELECT DISTINCT canonical_id AS c, 's' || CAST(sid AS VARCHAR) AS k FROM (SELECT canonical_id, unnest(source_ids) AS sid FROM era_research_outputs_canonical) WHERE sid IS NOT NULL
  UNION SELECT DISTINCT canonical_id, 'd' || {_DOI} FROM era_research_outputs_canonical WHERE doi_wellformed AND length({_DOI}) > 0),
star AS (SELECT c AS v, min(c) OVER (PARTITION BY k) AS u FROM keyed),
verdicts AS (
  SELECT least(left_id, right_id) AS u, greatest(left_id, right_id) AS v, verdict,
    row_number() OVER (PARTITION BY least(left_id, right_id), greatest(left_id, right_id) ORDER BY decided_at DESC NULLS LAST, pair_id DESC) AS n
  FROM canonical_match_pairs WHERE left_id <> right_id),
edges AS (
  SELECT u, v FROM star WHERE u < v
  UNION SELECT u, v FROM verdicts WHERE n = 1 AND verdict = 'accepted'
    AND u IN (SELECT canonical_id FROM era_research_outputs_canonical) AND v IN (SELECT canonical_id FROM era_research_outputs_canonical)),
both_ways AS (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT a AS canonical_id, min(b) AS group_id FROM reach GROUP BY a""",
}
