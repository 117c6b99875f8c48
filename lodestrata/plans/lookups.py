"""Joins against masters, code fan-out, tags and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.codes import BUILDING_TYPES
from lodestrata.operators import lookup
from lodestrata.operators.upsert import still_failed
from lodestrata.plans.registry import query
from lodestrata.plans.rent import FLOOR_YM, TRANS_SQL, statistics, transactions
from lodestrata.session import table

#: Band codes with open ends, as the code table has them.
BANDS = (("ar_01", None, 60.0), ("ar_02", 60.01, 85.0), ("ar_03", 85.01, 102.0), ("ar_04", 102.01, 135.0), ("ar_05", 135.01, None))


def codes(spark: SparkSession) -> DataFrame:
    """The code table; flags stand for the types of transaction files."""
    flags = {"단독다가구": "A", "연립다세대": "N", "오피스텔": "R", "아파트": "X"}
    return spark.createDataFrame([(c, n, flags[f]) for c, n, f in BUILDING_TYPES], "code string, name string, rtms_value string")


@query(
    "rent_code_fanout",
    f"""WITH s AS (SELECT building_type, emd_code, area_range, count(*) AS transaction_count, round(avg(converted_price), 2) AS avg_converted_price FROM ({TRANS_SQL})
  WHERE converted_price IS NOT NULL AND area_range IS NOT NULL AND emd_code IS NOT NULL AND contract_year_month >= {FLOOR_YM} GROUP BY ALL),
c(code, rtms_value) AS (VALUES ('bt_01', 'A'), ('bt_02', 'N'), ('bt_03', 'N'), ('bt_04', 'R'), ('bt_05', 'X'))
SELECT code, emd_code, area_range, transaction_count, avg_converted_price FROM s JOIN c ON s.building_type = c.rtms_value""",
)
def rent_code_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_matview_housing: two codes share a type, so its rows double."""
    s = statistics(transactions(spark, sf_dir), FLOOR_YM)
    return s.join(lookup.small(codes(spark)), F.col("building_type") == F.col("rtms_value")).select("code", "emd_code", "area_range", "transaction_count", "avg_converted_price")


@query(
    "area_bands",
    """WITH b(band, lo, hi) AS (VALUES ('ar_01', CAST(NULL AS DOUBLE), 60.0), ('ar_02', 60.01, 85.0), ('ar_03', 85.01, 102.0), ('ar_04', 102.01, 135.0), ('ar_05', 135.01, NULL))
SELECT coalesce(band, 'none') AS band, count(*) AS n FROM lineitem LEFT JOIN b ON l_quantity * 3 >= coalesce(lo, '-infinity'::DOUBLE) AND l_quantity * 3 <= coalesce(hi, 'infinity'::DOUBLE) GROUP BY 1""",
)
def area_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_area_range_band over a code table of five rows."""
    bands = lookup.small(spark.createDataFrame(BANDS, "band string, lo double, hi double"))
    joined = table(spark, sf_dir, "lineitem").select("l_quantity").join(bands, lookup.in_band(F.col("l_quantity") * 3, F.col("lo"), F.col("hi")), "left")
    return joined.groupBy(F.coalesce("band", F.lit("none")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


NAMES = "CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN concat(substring(n_name, 1, 2), ' ', substring(n_name, 3)) WHEN 2 THEN concat(n_name, ' DONG') ELSE concat('#', CAST(c_custkey AS STRING)) END"


@query(
    "staged_lookup",
    f"""WITH r AS (SELECT c_custkey AS id, {NAMES} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT r.id, r.name, max_by(n_nationkey, n_nationkey) AS k FROM r LEFT JOIN nation ON name = n_name GROUP BY ALL),
b AS (SELECT e.id, e.name, e.k, max_by(n_nationkey, n_nationkey) AS k2 FROM e LEFT JOIN nation ON replace(name, ' ', '') = replace(n_name, ' ', '') GROUP BY ALL),
c AS (SELECT b.id, b.name, b.k, b.k2, min_by(n_nationkey, n_nationkey) AS k3 FROM b LEFT JOIN nation ON contains(name, n_name) OR contains(n_name, name) GROUP BY ALL)
SELECT id, coalesce(k, k2, k3) AS code, CASE WHEN k IS NOT NULL THEN 'exact' WHEN k2 IS NOT NULL THEN 'no_blanks' WHEN k3 IS NOT NULL THEN 'contains' END AS stage FROM c""",
)
def staged_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_dong_exact, join_dong_nospace, join_dong_contains, join_bt_exact_then_contains."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS id", f"{NAMES} AS name")
    master = nation.select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    return lookup.staged_lookup(rows, "name", master).select("id", "code", "stage")


@query(
    "mark_join",
    """WITH m AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey, m.c_custkey IS NOT NULL AS known, m.c_custkey AS valid_key, coalesce(m.c_custkey, -1) AS key_or_default FROM orders LEFT JOIN m ON o_custkey = m.c_custkey""",
)
def mark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """semi_valid_code, fallback_platform."""
    master = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey")
    marked = lookup.mark(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", master, "c_custkey")
    key = F.when(F.col("known"), F.col("o_custkey"))
    return marked.select("o_orderkey", "known", key.alias("valid_key"), F.coalesce(key, F.lit(-1)).alias("key_or_default"))


@query("semi_features", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """semi_units_exist."""
    units = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(units, "l_orderkey", "left_semi")


@query("anti_failed", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 AND c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 2 = 0)")
def anti_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anti_success_names."""
    c = table(spark, sf_dir, "customer")
    return still_failed(c.where("c_acctbal < 0").select("c_custkey", "c_name"), c.where("c_custkey % 2 = 0"), "c_name").select("c_custkey", "c_name")


@query(
    "tag_pivot",
    """SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), '') AS f_tags,
  coalesce(string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), '') AS o_tags, count(o_orderkey) AS n_tags
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def tag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_string_distinct_filter, join_notice_tags_left: tags are aggregated before the join."""
    tags = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))), ", ")
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(tags("F").alias("f_tags"), tags("O").alias("o_tags"), F.count("o_orderkey").alias("n_tags"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(each, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("f_tags", F.lit("")).alias("f_tags"), F.coalesce("o_tags", F.lit("")).alias("o_tags"), F.coalesce("n_tags", F.lit(0)).alias("n_tags"))


@query(
    "first_file_rows",
    """WITH f AS (SELECT l_partkey AS k, l_suppkey % 4 AS file_no, l_orderkey, l_linenumber FROM lineitem), r AS (SELECT p_partkey FROM part WHERE p_size > 40)
SELECT k AS notice, file_no, l_orderkey, l_linenumber FROM (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY file_no) AS d FROM f JOIN r ON k = p_partkey) WHERE d = 1""",
)
def first_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_notice_occupancy: quoted keys, the first file with a match."""
    notices = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").cast("string").alias("notice"))
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"')).alias("notice"), (F.col("l_suppkey") % 4).alias("file_no"), "l_orderkey", "l_linenumber")
    found = lookup.first_file_rows(notices, "notice", files, "file_no")
    return found.select(F.col("notice").cast("bigint").alias("notice"), "file_no", "l_orderkey", "l_linenumber")


@query(
    "first_match",
    """SELECT p_partkey, coalesce(min_by(l_returnflag, l_orderkey * 10 + l_linenumber), 'unknown') AS unit_type FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY p_partkey""",
)
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_raw_unit_type, join_addr_ext_id."""
    raw = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("unit_type"))
    return lookup.first_match(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", raw, "pos", "unit_type", "unknown")


@query(
    "models_embeddings",
    "SELECT m.label AS model, count(e.vec_id) AS n_embeddings FROM (SELECT unnest(range(12))::INTEGER AS label) m LEFT JOIN embeddings e ON e.label = m.label GROUP BY m.label",
)
def models_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_model_embedding_left: models without an embedding count 0."""
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("vec_id").alias("n"))
    models = spark.range(12).select(F.col("id").cast("int").alias("model"))
    return models.join(counts, F.col("model") == F.col("label"), "left").select("model", F.coalesce("n", F.lit(0)).alias("n_embeddings"))


@query(
    "notice_address",
    """SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, 'A') AND s_acctbal > 0""",
)
def notice_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_notice_address, join_distance_3way, flt_like_contains."""
    near = table(spark, sf_dir, "nation").where(F.col("n_name").contains("A"))
    homes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(near, F.col("s_nationkey") == F.col("n_nationkey"))
    return homes.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")
