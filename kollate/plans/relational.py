"""Filters, joins, aggregates, windows, set operations and nested lists over the star schema and the domain tables."""

from pyspark.sql import Window, functions as F

from kollate.functions import text
from kollate.operators import link, resolve
from kollate.plans.registry import query

YEAR = "year(l_shipdate)"


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def grouped_aggregates(t):
    d = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, CAST(sum((o_totalprice > 200000)::INT) AS BIGINT) AS n_large, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_o, round(sum((o_orderstatus = 'F')::INT) * 100.0 / count(*), 2)::DOUBLE AS pct_f, round(avg((o_orderstatus = 'F')::INT) * 100, 2) AS avg_f FROM orders GROUP BY 1")
def conditional_counts(t):
    f = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(f).alias("n_f"), F.sum((F.col("o_totalprice") > 200000).cast("int")).alias("n_large"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("n_o"), F.round(F.sum(f.cast("double")) * 100.0 / F.count("*"), 2).alias("pct_f"), F.round(F.avg(f.cast("double")) * 100, 2).alias("avg_f"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_types, count(DISTINCT (event_type, user_id)) AS n_pairs, count(DISTINCT CASE WHEN value > 50 THEN event_type END) AS n_high, bool_or(value > 90) AS any_high, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY 1")
def distinct_counts(t):
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("n_types"), F.countDistinct(F.struct("event_type", "user_id")).alias("n_pairs"), F.countDistinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("n_high"), F.bool_or(F.col("value") > 90).alias("any_high"), F.array_sort(F.collect_set("event_type")).alias("types"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS usual FROM c GROUP BY 1")
def most_frequent(t):
    return t.events.groupBy("user_id").agg(F.mode("event_type", True).alias("usual"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5 AND count(DISTINCT p_size) > 3")
def having(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_size").alias("s")).filter("n > 5 AND s > 3").select("p_brand", "n")


@query("WITH k AS (SELECT user_id, count(*) AS k FROM events GROUP BY 1) SELECT k, count(*) AS n_users, CAST(k * count(*) AS BIGINT) AS n_events FROM k GROUP BY 1")
def group_size_spectrum(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n_users")).withColumn("n_events", F.col("k") * F.col("n_users"))


@query("SELECT n_name, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def share_of_total(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).cast("double"))  # 25 nations at most


@query("SELECT l_partkey AS part, min(l_suppkey) AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_extendedprice, l_suppkey, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1 GROUP BY 1")
def best_candidate(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("best"), "l_discount", "l_extendedprice", "l_orderkey", "l_linenumber")
    return link.best(rows, "part", -F.col("l_discount"), F.col("l_extendedprice"), F.col("best"), F.col("l_orderkey"), F.col("l_linenumber")).select("part", "best")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events")
def row_numbers(t):
    return resolve.ranked(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def anti_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, year(l_shipdate) - year(o_orderdate) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(year(l_shipdate) - year(o_orderdate)) = 1")
def equi_and_theta_join(t):
    gap = F.year("l_shipdate") - F.year("o_orderdate")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("gap", gap.cast("long")).filter(F.abs("gap") == 1).select("l_orderkey", "l_linenumber", "gap")


@query("SELECT n_name, r_name, count(s_suppkey) AS n_suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def left_join_enrich(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49) USING (l_partkey, l_suppkey) WHERE l_quantity < 10")
def composite_key_join(t):
    big = t.lineitem.filter("l_quantity >= 49").select("l_partkey", "l_suppkey").distinct()
    return t.lineitem.filter("l_quantity < 10").join(big, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("WITH a AS (SELECT o_orderkey AS k, 'large' AS src FROM orders WHERE o_totalprice > 300000), b AS (SELECT o_orderkey AS k, 'urgent' AS src FROM orders WHERE o_orderpriority = '1-URGENT') SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)")
def priority_union(t):
    a = t.orders.filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("k"), F.lit("large").alias("src"))
    b = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("urgent").alias("src"))
    return link.priority_union(a, b, "k")


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def union_distinct(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).union(t.customer.filter("c_acctbal > 9000").select("c_nationkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def top_ten(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT row_id, title FROM era_research_outputs_canonical ORDER BY md5(CAST(row_id AS VARCHAR) || '-42'), row_id LIMIT 20")
def seeded_sample(t):
    """Twenty works in an order that a seed fixes: a random sample that comes out alike anywhere."""
    return t.works.select("row_id", "title").orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit("-42"))), "row_id").limit(20)


@query("SELECT row_id, delivered_by FROM era_research_outputs_canonical WHERE doi IS NOT NULL ORDER BY CASE WHEN doi_wellformed THEN 0 ELSE 1 END, md5(CAST(row_id AS VARCHAR) || '-7'), row_id LIMIT 50")
def priority_sample(t):
    """Fifty works, those with a well-formed DOI first, in a seeded order each."""
    first = F.when(F.col("doi_wellformed"), 0).otherwise(1)
    return t.works.filter("doi IS NOT NULL").select("row_id", "delivered_by", first.alias("p")).orderBy("p", F.md5(F.concat(F.col("row_id").cast("string"), F.lit("-7"))), "row_id").limit(50).select("row_id", "delivered_by")


@query("SELECT vec_id, i AS position, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def unnest_with_position(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("long").alias("position"), F.col("v").cast("double").alias("v"))


@query("SELECT canonical_id, row_id, institutions[1] AS first, len(institutions) AS n FROM era_research_outputs_canonical")
def list_access(t):
    return t.works.select("canonical_id", "row_id", F.try_element_at("institutions", F.lit(1)).alias("first"), F.size("institutions").cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%doi:10.%' OR lower(section) LIKE '%note%'")
def contains_any(t):
    return t.documents.filter(F.contains(F.lower("text"), F.lit("doi:10.")) | F.contains(F.lower("section"), F.lit("note"))).select("doc_id")


@query("SELECT row_id, doi FROM era_research_outputs_canonical WHERE regexp_full_match(doi, '10\\.[0-9]{4,9}/\\S+')")
def regex_filter(t):
    return t.works.filter(F.col("doi").rlike(r"^10\.[0-9]{4,9}/\S+$")).select("row_id", "doi")


@query("SELECT row_id, title FROM era_research_outputs_canonical WHERE research_output_type = 'Journal Article' AND (doi IS NULL OR doi_wellformed = FALSE) AND length(title) >= 15")
def title_search_targets(t):
    return t.works.filter("research_output_type = 'Journal Article' AND (doi IS NULL OR doi_wellformed = false)").filter(F.length("title") >= 15).select("row_id", "title")


@query("SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem WHERE l_quantity = 50")
def star_minus(t):
    return t.lineitem.filter("l_quantity = 50").drop("l_tax", "l_discount")


@query("""SELECT delivered_by, institution_name, trust_level, count(*) AS n FROM era_research_outputs_canonical LEFT JOIN era_institutions ON delivered_by = institution GROUP BY 1, 2, 3""")
def institution_lookup(t):
    n = t.works.groupBy("delivered_by").agg(F.count("*").alias("n"))
    return n.join(t.era_institutions, F.col("delivered_by") == F.col("institution"), "left").select("delivered_by", "institution_name", "trust_level", "n")


@query("""WITH v AS (SELECT outlet_isbn AS key, trim(regexp_replace(lower(outlet), '\\s+', ' ', 'g')) AS o FROM era_research_outputs_canonical WHERE outlet_isbn IS NOT NULL AND outlet_isbn <> '00000'),
c AS (SELECT key, nullif(trim(regexp_replace(o, '\\.$', '')), '') AS value, count(*) AS n FROM v GROUP BY 1, 2) SELECT key, first(value ORDER BY n DESC, value) AS value FROM c WHERE value IS NOT NULL GROUP BY 1""")
def consensus_names(t):
    from kollate.operators.clean import consensus_vocabulary

    return consensus_vocabulary(t.works, "outlet_isbn", "outlet")
