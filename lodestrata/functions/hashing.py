"""Identifiers made of hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(value: Column, kind: str = "string") -> Column:
    """A value as the identifiers spell it: null is ``None``, a double always has a fraction and no exponent."""
    if kind == "double":
        whole = value == F.floor(value)
        text = F.when(whole, F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("None"))


def unit_id(notice: Column, room: Column, floor: Column, area: Column) -> Column:
    """``space_`` and twelve hex digits of a unit's key."""
    key = F.concat_ws("_", plain(notice), plain(room), plain(floor), plain(area, "double"))
    return F.concat(F.lit("space_"), F.substring(F.md5(key), 1, 12))


def address_id(raw: Column) -> Column:
    return F.substring(F.md5(raw), 1, 16)


def joined_id(prefix: str, length: int, *parts: Column) -> Column:
    """A prefix and hex digits of the non-empty parts, joined by pipes."""
    filled = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *filled), 256), 1, length))


def url_key(url: Column) -> Column:
    """Scheme, host and path of a url."""
    return F.regexp_replace(url, r"[?#].*$", "")


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)
