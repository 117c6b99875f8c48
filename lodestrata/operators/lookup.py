"""Joins against code lists and masters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.containment import containing

#: Rows up to which a master may be broadcast; larger ones, and wide ones, are joined by shuffling.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; the count stops at the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def first_by(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key in an order that tells rows apart."""
    keys, orders = [key] if isinstance(key, str) else key, [order] if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def contained_code(names: DataFrame, master: DataFrame) -> DataFrame:
    """name and code of the first master line whose name lies in ``name``, or in whose name it lies; names without one are absent.

    Pairs come from an index of grams, so neither table needs to be small. An empty name
    lies in all of the master's, and an empty one of the master in all names.
    """
    first = master.where("name IS NOT NULL").groupBy(F.col("name").alias("m_name")).agg(F.min_by(F.struct("line_no", "code"), "line_no").alias("line"))
    names = names.where("name IS NOT NULL").select("name").distinct()
    inside = containing(names.select(F.col("name").alias("whole")), first.select(F.col("m_name").alias("part"))).select(F.col("whole").alias("name"), F.col("part").alias("m_name"))
    around = containing(first.select(F.col("m_name").alias("whole")), names.select(F.col("name").alias("part"))).select(F.col("part").alias("name"), F.col("whole").alias("m_name"))
    met = inside.unionByName(around).join(first, "m_name").select("name", "line")
    least = lambda rows: F.broadcast(rows.agg(F.min_by("line", "line.line_no").alias("line")).where("line IS NOT NULL"))  # noqa: E731  one row
    empty = names.crossJoin(least(first.where("m_name = ''")))
    blank = names.where("name = ''").crossJoin(least(first))
    every = met.unionByName(empty).unionByName(blank)
    return every.groupBy("name").agg(F.min_by("line", "line.line_no").alias("line")).select("name", "line.code")


def staged_lookup(rows: DataFrame, name: str, master: DataFrame) -> DataFrame:
    """Add ``code`` and ``stage``: the master's code for a name, by exact match, then without blanks, then by containment.

    ``master`` has line_no, name and code. Of equal names the last line wins, in the third
    stage the first line. The third stage takes only distinct names that the first two leave open.
    """
    exact = master.groupBy("name").agg(F.max_by("code", "line_no").alias("exact_code"))
    bare = master.groupBy(F.regexp_replace("name", r"\s", "").alias("bare_name")).agg(F.max_by("code", "line_no").alias("bare_code"))
    names = rows.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    two = names.join(exact, "name", "left").withColumn("bare_name", F.regexp_replace("name", r"\s", "")).join(bare, "bare_name", "left")
    found = two.where("exact_code IS NOT NULL OR bare_code IS NOT NULL")
    third = contained_code(two.where("exact_code IS NULL AND bare_code IS NULL"), master).withColumn("stage", F.lit("contains"))
    stage = F.when(F.col("exact_code").isNotNull(), "exact").otherwise("no_blanks")
    codes = found.select("name", F.coalesce("exact_code", "bare_code").alias("code"), stage.alias("stage")).unionByName(third)
    return rows.join(codes.withColumnRenamed("name", "_name"), F.col(name) == F.col("_name"), "left").drop("_name")


def mark(rows: DataFrame, key: str, master: DataFrame, master_key: str, out: str = "known") -> DataFrame:
    """Add whether the key is in the master; a null key is not."""
    keys = master.select(F.col(master_key).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    return rows.join(keys, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def valid_or_null(rows: DataFrame, key: str, master: DataFrame, master_key: str) -> DataFrame:
    """The key where the master has it, else null."""
    return mark(rows, key, master, master_key, "_known").withColumn(key, F.when(F.col("_known"), F.col(key))).drop("_known")


def valid_or(rows: DataFrame, key: str, master: DataFrame, master_key: str, other: Column) -> DataFrame:
    """The key where the master has it, else another value."""
    return mark(rows, key, master, master_key, "_known").withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(other)).drop("_known")


def first_match(rows: DataFrame, key: str, other: DataFrame, order: str, value: str, default: str) -> DataFrame:
    """Add ``value`` of the first row of the other table with the same key; ``default`` without one."""
    first = other.groupBy(F.col(key).alias("_key")).agg(F.min_by(value, order).alias(value))
    return rows.join(first, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default))).drop("_key")


def first_file_rows(rows: DataFrame, key: str, files: DataFrame, file_no: str) -> DataFrame:
    """Rows of ``files`` with the same key, blanks and quotes aside, from the first file that has any."""
    clean = lambda c: F.trim(F.translate(c, '"', ""))
    matched = rows.select(key).join(files.withColumn("_key", clean(F.col(key))).drop(key), clean(F.col(key)) == F.col("_key"))
    return matched.withColumn("_file", F.dense_rank().over(Window.partitionBy("_key").orderBy(file_no))).where("_file = 1").drop("_file", "_key")


def in_band(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies in a band whose ends may be open (null)."""
    return (value >= F.coalesce(low, F.lit(float("-inf")))) & (value <= F.coalesce(high, F.lit(float("inf"))))
