"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in all floating columns, those inside arrays of structs included by ``to_json``'s null handling."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(k, DoubleType | FloatType) else F.col(c) for c, k in kinds.items()])


def json_array_text(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, one column: the whole table as a JSON array. For small tables only; use ``append_json_lines`` for others."""
    keyed = without_nan(df)
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.struct(*keyed.columns).alias("row"))))
    return keyed.agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("json"))


def write_csv(df: DataFrame, path: str, decimals: int = 4, bom: bool = True) -> None:
    """CSV with a header; floating columns have a fixed number of decimals, and the first header may carry a byte order mark."""
    shown = df.select(*[F.format_string(f"%.{decimals}f", c).alias(c) if isinstance(df.schema[c].dataType, DoubleType | FloatType) else F.col(c) for c in df.columns])
    if bom and df.columns:
        shown = shown.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    shown.write.mode("overwrite").option("header", True).csv(path)


def merged(tables: list[DataFrame]) -> DataFrame:
    """Tables of several categories as one; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def reload_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that ``df`` has, so that a repeated load leaves no duplicates."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def reload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
