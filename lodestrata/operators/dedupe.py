"""First rows, duplicates and running identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import shared_folder


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``copy_no``: 1 for the first row of a key. Null parts of a key count as equal."""
    return df.withColumn("copy_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return ranked(df, keys, order).where("copy_no = 1").drop("copy_no")


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that ``first_rows`` leaves out."""
    return ranked(df, keys, order).where("copy_no > 1")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: original, kept and removed rows. Counts of keys are aggregated first, so a hot key costs nothing."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed")
    )


def numbered(df: DataFrame, category: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the place of a row, from 1, in its category and order.

    Rows are sorted by ranges, which cut a large category, and written once. A range's part of a
    category starts after what earlier ranges have of it: one row a range and category is summed.
    """
    spark = df.sparkSession
    path, by = shared_folder(spark, "numbered"), [category, *order]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    held = ranged.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(category).alias("category"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("no"))
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    parts = held.groupBy("category", "part").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("category").alias("s_category"), F.col("part").alias("s_part"), "first", before.alias("before"))
    placed = held.join(starts, F.col("category").eqNullSafe(F.col("s_category")) & (F.col("part") == F.col("s_part")))
    return placed.select("row.*", (F.col("no") - F.col("first") + F.col("before") + 1).alias(out))


def ordinal_ids(df: DataFrame, category: str, order: list[str], existing: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Add ``ordinal_id``: the category and a running number, zero-padded to ``digits`` or longer, going on from ``existing`` (category, last_no)."""
    joined = numbered(df, category, order, "_number").withColumn("_last", F.lit(0))
    if existing is not None:
        last = existing.select(F.col(category).alias("_category"), F.col("last_no").alias("_last"))
        joined = joined.drop("_last").join(last, F.col(category) == F.col("_category"), "left").drop("_category")
    total = (F.col("_number") + F.coalesce("_last", F.lit(0))).cast("string")
    padded = F.when(F.length(total) >= digits, total).otherwise(F.lpad(total, digits, "0"))
    return joined.withColumn("ordinal_id", F.concat(F.col(category), padded)).drop("_number", "_last")


def resume_points(log: DataFrame, kind: str = "kind", row: str = "row_index") -> DataFrame:
    """For each kind the row index to go on from."""
    return log.groupBy(kind).agg((F.max(row) + 1).alias("resume_at"))
