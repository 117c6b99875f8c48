"""Facility, notice, unit and tag records made from suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import records
from lodestrata.plans.registry import query
from lodestrata.session import table

ROAD = "CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE concat('road ', CAST(s_suppkey AS STRING)) END"
SPECIALITY = "CASE WHEN s_suppkey % 4 = 0 THEN '내과 응급의학과' ELSE '내과' END"


@query(
    "facility_records",
    f"""WITH r AS (SELECT *, {ROAD} AS road, concat('lot ', CAST(s_suppkey AS VARCHAR)) AS lot, {SPECIALITY} AS spec FROM supplier)
SELECT 'hos' AS cd, s_name AS name, coalesce(nullif(trim(road), ''), lot) AS address_raw, CAST(NULL AS DOUBLE) AS lat, contains(spec, '응급') AS is_emergency, CAST(NULL AS BIGINT) AS capacity FROM r
UNION ALL SELECT 'child', s_name, lot, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 37.5 + s_suppkey / 1000 END, false, CAST(trunc(s_acctbal) AS BIGINT) FROM r
UNION ALL SELECT 'park', s_name, lot, NULL, false, NULL FROM r""",
)
def facility_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_facility_record, prj_addr_coalesce, prj_emergency_flag, prj_safe_cast: three of the ten categories."""
    s = table(spark, sf_dir, "supplier")
    lot = "concat('lot ', CAST(s_suppkey AS STRING))"
    hospital = s.selectExpr("s_name AS `사업장명`", f"{ROAD} AS `도로명전체주소`", f"{lot} AS `소재지전체주소`", f"{SPECIALITY} AS `진료과목내용명`")
    care = s.selectExpr("s_name AS CRNAME", f"{lot} AS CRADDR", "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(37.5 + s_suppkey / 1000 AS STRING) END AS LA", "CAST(s_acctbal AS STRING) AS CRCAPAT")
    park = s.selectExpr("s_name AS P_PARK", f"{lot} AS P_ADDR")
    return records.facilities({"hospital": hospital, "childCare": care, "park": park}).select("cd", "name", "address_raw", "lat", "is_emergency", "capacity")


NOTICE = (
    "concat(CASE o_orderkey % 2 WHEN 0 THEN 'sohouse_' ELSE 'cohouse_' END, CAST(o_orderkey AS STRING)) AS notice_id", "CASE o_orderkey % 3 WHEN 0 THEN '' ELSE o_orderpriority END AS house_name", "concat('addr ', CAST(o_custkey AS STRING)) AS address",
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'bt' END AS building_type", "CASE o_orderkey % 3 WHEN 0 THEN 'a.jpg;b.jpg' WHEN 1 THEN 'nan' ELSE ' ' END AS image_paths", "'' AS floorplan_paths", "'x.pdf' AS document_paths", "'u' AS list_url",
    "'2024.01.02' AS last_modified", "'bad' AS crawl_date",
)


@query(
    "notice_records",
    f"""WITH r AS (SELECT {', '.join(NOTICE)} FROM orders) SELECT notice_id, CASE WHEN contains(notice_id, 'sohouse') THEN 'sohouse' ELSE 'cohouse' END AS platform_id, coalesce(nullif(house_name, ''), address) AS title,
 substring(md5(address), 1, 16) AS address_id, coalesce(building_type, 'unknown') AS building_type, trim(image_paths) NOT IN ('', 'nan') AS has_images, false AS has_floorplan, true AS has_documents, CAST(DATE '2024-01-02' AS TIMESTAMP) AS posted_at FROM r""",
)
def notice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_notice, prj_platform_dim, hash_address_id."""
    rows = table(spark, sf_dir, "orders").selectExpr(*NOTICE)
    return records.notices(rows, {"sohouse": "sohouse"}, "cohouse").select("notice_id", "platform_id", "title", "address_id", "building_type", "has_images", "has_floorplan", "has_documents", "posted_at")


UNIT = (
    "CAST(l_orderkey AS STRING) AS notice_id", "concat(CAST(100 + l_linenumber AS STRING), '호') AS room", "concat('전용 ', CAST(CAST(l_quantity AS INT) AS STRING), '.5㎡') AS area", "concat(CAST(l_partkey AS STRING), '만원') AS deposit",
    "CASE WHEN l_linenumber % 2 = 0 THEN '문의' ELSE '300,000원' END AS rent", "CAST(NULL AS STRING) AS fee", "concat(CAST(l_linenumber AS STRING), '층') AS floor", "'2인' AS people", "'2024-05-01' AS available_at", "CASE WHEN l_linenumber = 1 THEN '가능' ELSE '불가능' END AS available",
)


@query(
    "unit_records",
    """SELECT CAST(l_orderkey AS VARCHAR) AS notice_id, CAST(l_quantity AS INTEGER) + 0.5::DOUBLE AS area_m2, l_partkey * 10000 AS deposit, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 300000 END AS rent,
 CAST(100 + l_linenumber AS VARCHAR) AS room_number, l_linenumber AS floor, 2 AS capacity, l_linenumber = 1 AS occupancy_available FROM lineitem""",
)
def unit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_unit, unit_from_occupancy."""
    return records.units(table(spark, sf_dir, "lineitem").selectExpr(*UNIT)).select("notice_id", "area_m2", "deposit", "rent", "room_number", "floor", "capacity", "occupancy_available")


@query(
    "tag_records",
    """SELECT o_orderkey AS notice_id, '테마' AS tag, o_orderpriority AS description FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, '지하철', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, '버스', 'b' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'other', 'v' FROM orders""",
)
def tag_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arr_theme_tags, arr_facility_tags."""
    o = table(spark, sf_dir, "orders")
    themes = o.select(F.col("o_orderkey").alias("notice_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("nan").alias("theme"), F.lit("").alias("subway_station"), F.lit(None).cast("string").alias("eligibility"))
    near = F.create_map(F.lit("subway"), F.col("o_orderstatus"), F.lit("subway_station"), F.concat("o_orderstatus", F.lit(" ")), F.lit("bus"), F.concat(F.lit("b"), F.col("o_orderstatus")), F.lit("other"), F.lit("v"), F.lit("none"), F.lit(""))
    return records.theme_tags(themes).unionByName(records.facility_tags(o.select(F.col("o_orderkey").alias("notice_id"), near.alias("facilities"))))


@query(
    "geocoded_addresses",
    """SELECT c_custkey, CASE WHEN ok THEN c_custkey / 100 END AS lat, CASE WHEN ok THEN '서울' ELSE 'addr' END AS ctpv_nm, CASE WHEN ok THEN '중구' ELSE CAST(c_custkey AS VARCHAR) END AS sgg_nm, CASE WHEN ok THEN 'code1' END AS emd_cd, ok AS success
FROM (SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM customer)""",
)
def geocoded_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_ext_geocode: a third of the addresses is known, another third lacks a coordinate."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("addr "), F.col("c_custkey").cast("string")).alias("address_raw"))
    g = c.where("c_custkey % 3 < 2").selectExpr("address_raw AS address", "CAST(c_custkey / 100 AS STRING) AS lat", "CASE WHEN c_custkey % 3 = 0 THEN '126.9' ELSE '' END AS lon", "'서울 중구' AS name")
    dong = spark.createDataFrame([("서울 중구", "code1")], "name string, code string")
    return records.geocoded(c, "address_raw", g, dong).select("c_custkey", "lat", "ctpv_nm", "sgg_nm", "emd_cd", "success")
