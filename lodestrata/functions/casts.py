"""Casts that never raise, and the treatment of blanks and not-a-number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """Null for blank text, else the text as it is."""
    return F.when(F.trim(text) != "", text)


def safe_float(text: Column) -> Column:
    """A double; null for blanks, ``nan`` and anything that is no number."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def safe_int(text: Column) -> Column:
    """An integer, truncated towards zero; null like ``safe_float``."""
    return safe_float(text).try_cast("bigint")


def safe_text(text: Column, length: int) -> Column:
    """Trimmed and cut text; null for blanks and ``nan``."""
    trimmed = F.trim(text.cast("string"))
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), F.substring(trimmed, 1, length))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def present(path: Column) -> Column:
    """Whether a path string names something."""
    return F.coalesce(~F.trim(path).isin("", "nan"), F.lit(False))


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("double"))
