"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layouts tried in order by ``flexible_timestamp``.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd")


def korean_date(text: Column) -> Column:
    """``yyyy-mm-dd`` of the first date of this century in a text (``2024.1.5``, ``2024년 1월 5일``, ``2024/01/05``)."""
    pattern = r"(20[0-9]{2})[.\-년/ ]\s*([0-9]{1,2})[.\-월/ ]\s*([0-9]{1,2})"
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))


def epoch_to_null(text: Column) -> Column:
    """Null for blanks, ``nan`` and the first day of 1970."""
    return F.when(~text.isin("", "1970-01-01", "1970-01-01T00:00:00", "nan"), text)


def flexible_timestamp(text: Column) -> Column:
    """A timestamp in any of the known layouts; null if none fits."""
    zoned = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    return F.coalesce(*(F.try_to_timestamp(zoned, F.lit(layout)) for layout in LAYOUTS))


def yearly_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Consecutive windows of a year from ``start``; the last one ends at ``end``. Columns window_no, window_start, window_end."""
    starts = spark.range(1).select(F.posexplode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 year)")).alias("window_no", "window_start"))
    last = F.least(F.date_sub(F.add_months("window_start", 12), 1), F.lit(end).cast("date"))
    return starts.where(F.col("window_start") <= F.lit(end).cast("date")).withColumn("window_end", last)
