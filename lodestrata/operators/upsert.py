"""Merging new rows into a table; results are new DataFrames, written by the caller."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both; where keys meet, the source's row (its last by ``order``) replaces the target's. Null keys never meet."""
    cols = target.columns
    if order is None:
        new = source.select(*cols).dropDuplicates(keys)
    else:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = source.withColumn("_rank", rank).where("_rank = 1").select(*cols)
    nameless = source.where(" OR ".join(f"{k} IS NULL" for k in keys)).select(*cols)
    named = new.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return target.join(named.select(*keys), keys, "left_anti").select(*cols).unionByName(named).unionByName(nameless)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target and those rows of the source whose key is new; of several the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = source.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def checked(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add ``error``: the name of the first check that fails, null if none; a null result fails."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]
    return df.withColumn("error", F.coalesce(*failed))


def accepted(df: DataFrame) -> DataFrame:
    return df.where("error IS NULL").drop("error")


def dead_letters(df: DataFrame, origin: str, row: str) -> DataFrame:
    """Rejected rows: origin, row_index, raw_data as JSON and error."""
    kept = [c for c in df.columns if c not in ("error", origin, row)]
    return df.where("error IS NOT NULL").select(F.col(origin).alias("origin"), F.col(row).alias("row_index"), F.to_json(F.struct(*kept)).alias("raw_data"), "error")


def retried(failed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The original rows of failures, fetched by file and row index."""
    return rows.join(failed.select(*keys).distinct(), keys)


def still_failed(failed: DataFrame, succeeded: DataFrame, name: str) -> DataFrame:
    """Failures but for those that have succeeded by now."""
    return failed.join(succeeded.select(name).distinct(), name, "left_anti")
