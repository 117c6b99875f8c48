"""Code lists and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Facility codes and their labels.
FACILITIES = {
    "child": "어린이집", "chsch": "유치원", "sch": "학교", "col": "대학교", "pha": "약국",
    "hos": "병원", "mt": "마트", "con": "편의점", "gym": "체육시설", "park": "공원",
}
# Building types as code, label, type in transaction files and band of the housing code.
BUILDING_TYPES = (
    ("bt_01", "단독다가구", "단독다가구"), ("bt_02", "연립주택", "연립다세대"), ("bt_03", "다세대주택", "연립다세대"),
    ("bt_04", "오피스텔", "오피스텔"), ("bt_05", "아파트", "아파트"),
)


def mapped(key: Column, table: Mapping[str, str]) -> Column:
    """The value of a key, null without one."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None).cast("string")


def label(key: Column, table: Mapping[str, str]) -> Column:
    """The label of a code; a code without one is its own label."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), key)


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def inverse(table: Mapping[str, str]) -> dict[str, str]:
    """The mapping read backwards; of equal values the last key wins."""
    return {v: k for k, v in table.items()}


def korean_name(label_text: Column) -> Column:
    """The part before a parenthesis, or the label itself if it holds Hangul; null else."""
    before = F.trim(F.regexp_extract(label_text, r"^([^(]*)\(", 1))
    return F.when(before != "", before).when(label_text.rlike("[가-힣]"), label_text)


def looks_like_area(text: Column) -> Column:
    """Whether a building type is really an area."""
    # Words and marks of areas.
    return F.coalesce(text.rlike(r"m²|㎡|m2|평|전용|공급|면적|/|~|이상|이하|범위"), F.lit(False))
