"""Deduplication, identifiers, merges, rejects and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing
from lodestrata.functions.codes import BUILDING_TYPES
from lodestrata.operators import dedupe, quality, upsert
from lodestrata.plans.registry import query
from lodestrata.session import table

UNIT_KEY = ["l_orderkey", "l_returnflag", "l_linestatus"]


@query(
    "dedupe_units",
    """SELECT l_orderkey, l_linenumber, 'space_' || substring(md5(CAST(l_orderkey AS VARCHAR) || '_' || l_returnflag || '_' || l_linestatus || '_' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0'), 1, 12) AS unit_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win_first_per_key, hash_unit_id; of rows with the same key and line number the one of the smallest quantity, which the id holds, is first."""
    first = dedupe.first_rows(table(spark, sf_dir, "lineitem").select(*UNIT_KEY, "l_linenumber", "l_quantity"), UNIT_KEY, ["l_linenumber", "l_quantity"])
    return first.select("l_orderkey", "l_linenumber", hashing.unit_id(F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")).alias("unit_id"))


@query(
    "dedupe_stats",
    "SELECT CAST(sum(n) AS BIGINT) AS original, count(*) AS kept, CAST(sum(n - 1) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus)",
)
def dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win_dedupe_stats."""
    return dedupe.duplicate_counts(table(spark, sf_dir, "lineitem"), UNIT_KEY)


@query(
    "duplicate_rows",
    "SELECT l_orderkey, l_linenumber, copy_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) AS copy_no FROM lineitem) WHERE copy_no > 1",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that deduplication drops."""
    return dedupe.duplicates(table(spark, sf_dir, "lineitem").select(*UNIT_KEY, "l_linenumber"), UNIT_KEY, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "copy_no")


@query(
    "ordinal_ids",
    """WITH e AS (SELECT p_brand, max(p_size) AS last_no FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand),
n AS (SELECT p_partkey, p.p_brand, row_number() OVER (PARTITION BY p.p_brand ORDER BY p_partkey) + coalesce(last_no, 0) AS n FROM part p LEFT JOIN e ON p.p_brand = e.p_brand)
SELECT p_partkey, p_brand || CASE WHEN length(CAST(n AS VARCHAR)) >= 4 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END AS ordinal_id FROM n""",
)
def ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win_ordinal_id, going on from the numbers in use."""
    part = table(spark, sf_dir, "part")
    used = part.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.max("p_size").alias("last_no"))
    return dedupe.ordinal_ids(part.select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], used).select("p_partkey", "ordinal_id")


@query("resume_points", "SELECT event_type AS kind, max(event_id) + 1 AS resume_at FROM events GROUP BY event_type")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win_resume_point, inc_resume."""
    return dedupe.resume_points(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("row_index")))


ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]


@query(
    "upsert_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sink_upsert_update: each source key comes twice, the later row wins."""
    o = table(spark, sf_dir, "orders").select(*ORDER)
    new = o.where("o_orderkey % 3 = 0")
    late = new.withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("seq", F.lit(2))
    source = new.withColumn("seq", F.lit(1)).unionByName(late)
    return upsert.merge(o.where("o_orderkey % 2 = 0"), source, ["o_orderkey"], "seq")


@query("insert_ignore", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'U' END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sink_upsert_ignore."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return upsert.insert_ignore(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"], ["o_orderstatus"])


CHECKS_SQL = "CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'negative_balance' WHEN NOT coalesce(c_mktsegment <> 'BUILDING', false) THEN 'segment' END"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return upsert.checked(c, {"negative_balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"})


@query("dead_letters", f"SELECT 'customer' AS origin, c_custkey AS row_index, error FROM (SELECT *, {CHECKS_SQL} AS error FROM customer) WHERE error IS NOT NULL")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sink_dead_letter."""
    return upsert.dead_letters(_checked(spark, sf_dir).withColumn("file", F.lit("customer")), "file", "c_custkey").select("origin", "row_index", "error")


@query("retry_dlq", f"SELECT c_custkey, c_name, c_acctbal FROM (SELECT *, {CHECKS_SQL} AS error FROM customer) WHERE error = 'segment'")
def retry_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inc_retry_failed, join_retry_row: the original rows of one kind of failure."""
    failed = _checked(spark, sf_dir).where("error = 'segment'")
    return upsert.retried(failed, table(spark, sf_dir, "customer"), ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("accepted_rows", f"SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM (SELECT *, {CHECKS_SQL} AS error FROM customer) WHERE error IS NULL")
def accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that pass every check."""
    return upsert.accepted(_checked(spark, sf_dir))


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(v) AS n_filled, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v IS NULL) AS n_empty,
 round(count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*), 6)::DOUBLE AS empty_percent FROM (SELECT nullif({c}, 0)::DOUBLE AS v FROM lineitem)"""


@query("quality_profile", " UNION ALL ".join(_profile_sql(c) for c in ("l_quantity", "l_discount", "l_tax")))
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_units_quality."""
    return quality.profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query(
    "anomaly_sample",
    "SELECT count(*) AS n_anomalies, (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM (SELECT c_custkey FROM customer WHERE c_acctbal <> 0 AND c_acctbal < 10000 AND c_acctbal < 0 ORDER BY c_custkey LIMIT 5)) AS first_ids FROM customer WHERE c_acctbal < 0",
)
def anomaly_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_anomaly_sample over negative balances; the sample of five is the feature."""
    low = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", F.col("c_custkey").alias("amount"), "c_acctbal")
    found = quality.anomalies(low.withColumn("amount", F.col("c_acctbal")).withColumn("pos", F.col("c_custkey")), "amount", "rent", "pos")
    ids = low.orderBy("c_custkey").limit(5).agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("first_ids"))
    return found.select("n_anomalies").crossJoin(ids)  # one row each


@query(
    "quality_score",
    """WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) + count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS i FROM customer
 UNION ALL SELECT count(*), count(*) FILTER (WHERE o_totalprice < 1000) FROM orders UNION ALL SELECT count(*), count(*) FILTER (WHERE s_acctbal < 0) FROM supplier UNION ALL SELECT count(*), 0 FROM part)
SELECT CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(i) AS BIGINT) AS n_issues, round(greatest(0, 100 - sum(i) * 100.0 / greatest(sum(n), 1)), 6)::DOUBLE AS quality_score FROM r""",
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_quality_score: four tables, one row each."""
    t = lambda name: table(spark, sf_dir, name)
    return quality.score([
        quality.issues(t("customer"), "customer", F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"), quality.issues(t("orders"), "orders", F.col("o_totalprice") < 1000),
        quality.issues(t("supplier"), "supplier", F.col("s_acctbal") < 0), quality.issues(t("part"), "part", F.col("p_partkey").isNull()),
    ])


@query(
    "type_distribution",
    """SELECT count(o_orderpriority) AS n_values, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_mapped, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS n_unmapped,
 coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')), '') AS unmapped,
 round(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) * 100.0 / count(o_orderpriority), 6)::DOUBLE AS coverage_percent FROM orders""",
)
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_type_distribution, agg_mapping_counters."""
    known = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority"))
    return quality.coverage(table(spark, sf_dir, "orders"), "o_orderpriority", known).withColumn("unmapped", F.array_join("unmapped", ","))


@query(
    "code_agreement",
    """WITH u AS (SELECT DISTINCT event_type AS t FROM events), k(t) AS (VALUES ('click'), ('view'), ('never'))
SELECT (SELECT count(*) FROM u)::INTEGER AS n_used, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM u WHERE t NOT IN (SELECT t FROM k)), '') AS unknown,
 coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM k WHERE t NOT IN (SELECT t FROM u)), '') AS unused,
 round((SELECT count(*) FROM u WHERE t IN (SELECT t FROM k)) * 100.0 / (SELECT count(*) FROM u), 6)::DOUBLE AS known_percent""",
)
def code_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_platform_consistency, set_difference."""
    found = quality.agreement(table(spark, sf_dir, "events"), "event_type", ["click", "view", "never"])
    return found.withColumn("unknown", F.array_join("unknown", ",")).withColumn("unused", F.array_join("unused", ","))


@query(
    "station_lines",
    """WITH f AS (SELECT l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT l_suppkey AS station, string_agg(l_returnflag, ', ' ORDER BY pos, l_returnflag) AS lines, count(*) > 1 AS is_transfer FROM f GROUP BY l_suppkey""",
)
def station_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_station_lines."""
    stops = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_returnflag").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return quality.station_lines(stops, "station", "line", "pos")


@query(
    "notice_ranges",
    "SELECT l_orderkey, min(l_quantity * 3) AS min_area, max(l_quantity * 3) AS max_area, min(l_linenumber) AS min_floor, max(l_linenumber) AS max_floor FROM lineitem GROUP BY l_orderkey",
)
def notice_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_notice_ranges."""
    area = F.col("l_quantity") * 3
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(area).alias("min_area"), F.max(area).alias("max_area"), F.min("l_linenumber").alias("min_floor"), F.max("l_linenumber").alias("max_floor"))


TYPES = tuple(n for _, n, _ in BUILDING_TYPES)


@query(
    "global_counts",
    "SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations",
)
def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_global_counts."""
    one = lambda name, c: table(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), c.alias("n"))
    return one("documents", F.count(F.lit(1))).unionByName(one("embeddings", F.count(F.lit(1)))).unionByName(one("conversations", F.countDistinct("conv_id")))


RENT = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(l_quantity * 3 AS STRING) END AS area, CASE l_returnflag WHEN 'A' THEN '단독다가구' ELSE '아파트' END AS kind,
 CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(l_orderkey AS STRING), ',000') WHEN 1 THEN 'x' ELSE CAST(l_orderkey AS STRING) END AS deposit,
 CASE WHEN l_linenumber = 7 THEN '' ELSE concat('2023', lpad(CAST(l_linenumber AS STRING), 2, '0')) END AS ym, CASE l_linenumber % 3 WHEN 0 THEN '-' ELSE '202301~202501' END AS period FROM lineitem"""


@query(
    "rent_records",
    f"""WITH r AS ({RENT})
SELECT id, TRY_CAST(area AS DOUBLE) AS area_m2, CASE WHEN kind = '단독다가구' THEN '계약면적' ELSE '전용면적' END AS area_type, CAST(ym AS INTEGER) AS contract_year_month,
  coalesce(TRY_CAST(replace(deposit, ',', '') AS BIGINT), 0) * 10000 AS deposit_amount, CASE WHEN period <> '-' THEN CAST(substring(period, 1, 6) AS INTEGER) END AS contract_start_ym
FROM r WHERE TRY_CAST(area AS DOUBLE) IS NOT NULL AND TRY_CAST(ym AS INTEGER) IS NOT NULL""",
)
def rent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_rent_record, prj_is_area_type, prj_rename_map: text fields to typed records; rows without area or month are rejected."""
    exprs = RENT.removeprefix("SELECT ").removesuffix(" FROM lineitem")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("rent_raw_lineitem")
    raw = spark.sql(f"SELECT {exprs} FROM rent_raw_lineitem")
    won = F.coalesce(F.regexp_replace("deposit", ",", "").try_cast("bigint"), F.lit(0)) * 10_000
    start = F.when(F.col("period") != "-", F.substring("period", 1, 6).try_cast("int"))
    typed = raw.select(
        "id", F.col("area").try_cast("double").alias("area_m2"), F.when(F.col("kind") == "단독다가구", "계약면적").otherwise("전용면적").alias("area_type"), F.col("ym").try_cast("int").alias("contract_year_month"),
        won.alias("deposit_amount"), start.alias("contract_start_ym"),
    )
    return typed.where("area_m2 IS NOT NULL AND contract_year_month IS NOT NULL")
