"""Schemas of the tables, as DDL, and the rules their rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "notices": "notice_id string, platform_code string, title string, status string, address_raw string, address_id bigint, building_type string, notice_extra map<string,string>, has_images boolean, has_floorplan boolean, "
    "has_documents boolean, list_url string, detail_url string, posted_at timestamp, last_modified timestamp, apply_start_at timestamp, apply_end_at timestamp",
    "addresses": "id bigint, address_ext_id string, address_raw string, ctpv_nm string, sgg_nm string, emd_nm string, emd_cd string, building_main_no string, building_sub_no string, building_name string, road_name_full string, "
    "jibun_name_full string, latitude decimal(10,8), longitude decimal(11,8)",
    "units": "unit_id string, notice_id string, unit_type string, deposit decimal(18,2), rent decimal(18,2), maintenance_fee decimal(18,2), area_m2 decimal(18,2), floor string, room_number string, occupancy_available boolean, "
    "occupancy_available_at timestamp, capacity int",
    "unit_features": "unit_id string, room_count int, bathroom_count int, direction string",
    "notice_tags": "notice_id string, tag_type string, tag_value string",
    "platforms": "code string, name string, url string, is_active boolean",
    "code_master": "cd string, name string, description string, upper_cd string",
    "facility_info": "facility_id string, cd string, name string, address_raw string, address_id string, lat double, lon double, tel string, website string, operating_hours string, is_24h boolean, is_emergency boolean, capacity int, "
    "grade_level string, facility_extra string, data_source string",
    "transport_points": "id string, transport_type string, name string, official_code string, line_name string, stop_type string, is_transfer boolean, lat double, lon double, extra_info string",
    "housing_facility_distances": "notice_id string, facility_id string, distance_m int",
    "transactions_rent": "building_type string, sigungudong string, emd_code string, road_address string, building_name string, area_type string, area_m2 decimal(10,2), area_range string, floor int, contract_type string, "
    "contract_year_month int, contract_status string, contract_start_ym int, contract_end_ym int, deposit_amount bigint, monthly_rent bigint, converted_price decimal(15,2), construction_year int",
    "code_table": "code string, name_kr string, name_en string, code_type string, display_order int, rtms_value string, housing_code string, min_area decimal(5,2), max_area decimal(5,2)",
    "document_sources": "id bigint, file_name string, file_type string, metadata map<string,string>",
    "document_chunks": "chunk_id bigint, source_id bigint, chunk_index int, content string, chunk_type string, token_count int, metadata map<string,string>",
    "embeddings": "model_name string, chunk_id bigint, embedding array<float>",
    "search_logs": "model_id int, query string, query_embedding array<float>, top_k int, search_time_ms decimal(10,2), results struct<chunk_ids:array<bigint>,similarities:array<double>>, avg_similarity decimal(5,4), created_at timestamp",
    "users": "id bigint, email string, username string, role string",
    "conversations": "id bigint, user_id bigint, title string, updated_at timestamp",
    "messages": "id bigint, conversation_id bigint, role string, content string, created_at timestamp",
}
#: table -> unique keys.
KEYS = {"notices": ["notice_id"], "units": ["unit_id"], "notice_tags": ["notice_id", "tag_type", "tag_value"], "housing_facility_distances": ["notice_id", "facility_id"], "document_chunks": ["source_id", "chunk_index"], "users": ["email"]}
#: (child, column, parent, key, what becomes of rows without a parent)
PARENTS = (
    ("units", "notice_id", "notices", "notice_id", "cascade"), ("unit_features", "unit_id", "units", "unit_id", "cascade"), ("notice_tags", "notice_id", "notices", "notice_id", "cascade"),
    ("notices", "address_id", "addresses", "id", "set_null"), ("code_master", "upper_cd", "code_master", "cd", "restrict"), ("messages", "conversation_id", "conversations", "id", "cascade"), ("document_chunks", "source_id", "document_sources", "id", "cascade"),
)


def checks(table: str) -> dict[str, Column]:
    """The checks of a table's rows: name -> condition; null values pass, as in SQL."""
    c = F.col
    fine = lambda e: F.coalesce(e, F.lit(True))
    # Patterns, ranges and domains.
    rules = {
        "platforms": {"code": c("code").rlike("^[a-z_]+$")},
        "addresses": {"latitude": c("latitude").between(-90, 90), "longitude": c("longitude").between(-180, 180)},
        "notices": {"status": c("status").isin("open", "closed", "upcoming", "unknown"), "apply_period": c("apply_start_at") <= c("apply_end_at")},
        "unit_features": {"room_count": c("room_count").between(0, 10), "bathroom_count": c("bathroom_count").between(0, 5)},
        "users": {"email": c("email").rlike(r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$"), "role": c("role").isin("user", "admin")},
        "messages": {"role": c("role").isin("user", "assistant", "system"), "content": F.length("content") > 0},
    }
    return {name: fine(rule) for name, rule in rules.get(table, {}).items()}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent; a null reference is none."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def enforced(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """The child table after its parents went: ``cascade`` drops orphans, ``set_null`` clears the reference, ``restrict`` raises if there are any."""
    keys = parent.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct()
    if rule == "restrict":
        if not orphans(child, column, parent, key).isEmpty():
            raise ValueError(f"rows of {column} have no parent")
        return child
    joined = child.join(keys, F.col(column) == F.col("_k"), "left")
    if rule == "set_null":
        return joined.withColumn(column, F.when(F.col("_k").isNotNull(), F.col(column))).drop("_k")
    return joined.where(F.col(column).isNull() | F.col("_k").isNotNull()).drop("_k")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def touched(parents: DataFrame, key: str, children: DataFrame, reference: str, at: str) -> DataFrame:
    """Parents whose ``updated_at`` is not before their last child's time."""
    last = children.groupBy(F.col(reference).alias("_k")).agg(F.max(at).alias("_last"))
    return parents.join(last, F.col(key) == F.col("_k"), "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_k", "_last")
