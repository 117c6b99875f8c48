"""Profiles and scores of data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.money import THRESHOLDS


def empty(c: str) -> Column:
    """Null or zero."""
    return F.col(c).isNull() | (F.col(c) == 0)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n_filled, low, high, mean of the values that are neither null nor zero, n_empty and the share of empty ones in percent.

    All columns are aggregated in one pass, then unpivoted.
    """
    value = lambda c: F.when(~empty(c), F.col(c).cast("double"))
    parts = [F.struct(
        F.lit(c).alias("column_name"), F.count(value(c)).alias("n_filled"), F.min(value(c)).alias("low"), F.max(value(c)).alias("high"),
        F.round(F.avg(value(c)), 6).alias("mean"), F.count_if(empty(c)).alias("n_empty"),
        F.round(F.try_divide(F.count_if(empty(c)) * 100.0, F.count(F.lit(1))), 6).alias("empty_percent"),
    ) for c in columns]
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def anomalies(df: DataFrame, column: str, kind: str, order: str, sample: int = 5) -> DataFrame:
    """One row: how many amounts lie below the threshold of ``kind``, and the first ``sample`` of them in order."""
    low = df.where((F.col(column) != 0) & (F.col(column) < THRESHOLDS[kind]))
    first = low.orderBy(order).limit(sample).agg(F.array_sort(F.collect_list(F.struct(order, column))).alias("found"))
    return low.agg(F.count(F.lit(1)).alias("n_anomalies")).crossJoin(first).select("n_anomalies", F.transform("found", lambda x: x[column]).alias("first_values"))


def issues(df: DataFrame, name: str, *tests: Column) -> DataFrame:
    """One row: table_name, n_records and n_issues, the sum of failed tests."""
    failed = reduce(lambda a, b: a + b, [F.count_if(F.coalesce(t, F.lit(True))) for t in tests])
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_records"), failed.alias("n_issues"))


def score(reports: list[DataFrame]) -> DataFrame:
    """The reports' totals and 100 less the issues in percent of the records, 0 at least."""
    all_rows = reduce(DataFrame.unionByName, reports)
    total = all_rows.agg(F.sum("n_records").alias("n_records"), F.sum("n_issues").alias("n_issues"))
    left = 100 - F.col("n_issues") * 100.0 / F.greatest(F.col("n_records"), F.lit(1))
    return total.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), left), 6))


def coverage(df: DataFrame, column: str, mapped: Column) -> DataFrame:
    """One row: rows with a value, distinct values that no code has, and the share of rows with a code in percent."""
    has = F.col(column).isNotNull()
    return df.agg(
        F.count_if(has).alias("n_values"), F.count_if(has & mapped.isNotNull()).alias("n_mapped"), F.count_if(has & mapped.isNull()).alias("n_unmapped"),
        F.array_sort(F.collect_set(F.when(mapped.isNull(), F.col(column)))).alias("unmapped"),
        F.round(F.try_divide(F.count_if(has & mapped.isNotNull()) * 100.0, F.count_if(has)), 6).alias("coverage_percent"),
    )


def agreement(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """One row: codes in use, those that the list lacks, those of the list that are unused, and the share of used codes that it knows."""
    used = F.collect_set(column)
    listed = F.array(*[F.lit(k) for k in known])
    row = df.agg(F.array_sort(used).alias("used"))
    return row.select(
        F.size("used").alias("n_used"), F.array_sort(F.array_except("used", listed)).alias("unknown"), F.array_sort(F.array_except(listed, "used")).alias("unused"),
        F.round(F.try_divide(F.size(F.array_intersect("used", listed)) * 100.0, F.size("used")), 6).alias("known_percent"),
    )


def station_lines(df: DataFrame, station: str, line: str, pos: str) -> DataFrame:
    """Each station's lines in the order they were first seen, and whether one can change there."""
    first = df.groupBy(station, line).agg(F.min(pos).alias("_pos"))
    found = first.groupBy(station).agg(F.array_sort(F.collect_list(F.struct("_pos", line))).alias("_lines"))
    return found.select(station, F.array_join(F.transform("_lines", lambda x: x[line]), ", ").alias("lines"), (F.size("_lines") > 1).alias("is_transfer"))
