"""Statistics that are kept up batch by batch, so that a refresh reads only what is new.

Each batch leaves its partial aggregates (counts, sums, least and greatest) in a partition of its own number.
Loading a batch again replaces its partition, so a repeated or retried load changes nothing. The
statistics are the partial aggregates of all batches, merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of the rent statistics.
KEYS = ["building_type", "emd_code", "area_range"]


def partial(trans: DataFrame, floor_ym: int, keys: list[str] = KEYS) -> DataFrame:
    """Partial aggregates of rental transactions; those without a price, band, district or of an earlier month than ``floor_ym`` do not count."""
    kept = trans.where(F.col("converted_price").isNotNull() & F.col("area_range").isNotNull() & F.col("emd_code").isNotNull() & (F.col("contract_year_month") >= floor_ym))
    # Prices have two decimals; sums of whole hundredths do not depend on the order of addition.
    cents = F.round(F.col("converted_price") * 100).cast("decimal(20,0)")
    return kept.groupBy(*keys).agg(
        F.min("sigungudong").alias("sigungudong"), F.count(F.lit(1)).alias("n"), F.sum(cents).cast("decimal(38,0)").alias("cents"),
        F.min("contract_year_month").alias("start_ym"), F.max("contract_year_month").alias("end_ym"),
    )


def load(batch: DataFrame, number: int, path: str, floor_ym: int) -> None:
    """Write the partial aggregates of a batch; its number identifies it, and the last load of a number counts."""
    partial(batch, floor_ym).write.mode("overwrite").parquet(f"{path}/batch={number}")


def statistics(spark: SparkSession, path: str, keys: list[str] = KEYS) -> DataFrame:
    """The statistics of all batches: count, mean price and period of each key."""
    held = spark.read.option("basePath", path).parquet(path)
    merged = held.groupBy(*keys).agg(
        F.min("sigungudong").alias("sigungudong"), F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.min("start_ym").alias("period_start_ym"), F.max("end_ym").alias("period_end_ym")
    )
    # Half a hundredth is rounded up, in whole numbers.
    mean = F.expr("(2 * cents + n) DIV (2 * n)").cast("double") / 100
    return merged.select(*keys, "sigungudong", F.col("n").alias("transaction_count"), mean.alias("avg_converted_price"), "period_start_ym", "period_end_ym")
