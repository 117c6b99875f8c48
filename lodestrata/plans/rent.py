"""Rental-transaction queries: price statistics by type, district and area band.

The driver's tables hold no rental data, so ``lineitem`` stands in for it: quantity * 3 is
the area, extended price the deposit, tax * 10000 the monthly rent, the return flag the
building type, the supplier the district.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.money import area_range, converted_price
from lodestrata.plans.registry import query
from lodestrata.session import table

FLOOR_YM = 199501


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` seen as rental transactions, with the derived columns filled in."""
    line = table(spark, sf_dir, "lineitem")
    area = F.col("l_quantity") * 3
    ym = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("contract_year_month")
    return line.select(
        F.col("l_returnflag").alias("building_type"),
        F.col("l_suppkey").alias("emd_code"),
        F.concat(F.lit("dong-"), F.col("l_suppkey").cast("string")).alias("sigungudong"),
        area.alias("area_m2"),
        area_range(area).alias("area_range"),
        converted_price(F.col("l_extendedprice"), F.col("l_tax") * 10000, area).alias("converted_price"),
        ym,
    )


def statistics(trans: DataFrame, floor_ym: int) -> DataFrame:
    """Count, mean price and period per (building type, district, area band).

    One partial and one final hash aggregate; the predicates sit below them, at the scan.
    """
    kept = trans.where(
        F.col("converted_price").isNotNull()
        & F.col("area_range").isNotNull()
        & F.col("emd_code").isNotNull()
        & (F.col("contract_year_month") >= floor_ym)
    )
    return kept.groupBy("building_type", "emd_code", "area_range").agg(
        F.min("sigungudong").alias("sigungudong"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.round(F.avg("converted_price"), 2).alias("avg_converted_price"),
        F.min("contract_year_month").alias("period_start_ym"),
        F.max("contract_year_month").alias("period_end_ym"),
    )


AREA_SQL = """CASE WHEN area_m2 IS NULL THEN NULL WHEN area_m2 <= 60 THEN '~60이하' WHEN area_m2 <= 85 THEN '60초과~85이하'
  WHEN area_m2 <= 102 THEN '85초과~102이하' WHEN area_m2 <= 135 THEN '102초과~135이하' ELSE '135초과~' END"""

TRANS_SQL = f"""SELECT building_type, emd_code, sigungudong, area_m2, {AREA_SQL} AS area_range,
  CASE WHEN area_m2 > 0 THEN round((deposit + monthly * 100.0) / area_m2, 2) END AS converted_price, contract_year_month
FROM (SELECT l_returnflag AS building_type, l_suppkey AS emd_code, 'dong-' || l_suppkey AS sigungudong,
  l_quantity * 3 AS area_m2, l_extendedprice AS deposit, l_tax * 10000 AS monthly,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS contract_year_month FROM lineitem)"""


@query(
    "rent_statistics",
    f"""SELECT building_type, emd_code, area_range, min(sigungudong) AS sigungudong, count(*) AS transaction_count,
  round(avg(converted_price), 2) AS avg_converted_price, min(contract_year_month) AS period_start_ym,
  max(contract_year_month) AS period_end_ym
FROM ({TRANS_SQL}) WHERE converted_price IS NOT NULL AND area_range IS NOT NULL AND emd_code IS NOT NULL
  AND contract_year_month >= {FLOOR_YM} GROUP BY building_type, emd_code, area_range""",
)
def rent_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(transactions(spark, sf_dir), FLOOR_YM)
