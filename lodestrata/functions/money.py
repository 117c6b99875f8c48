"""Money, area and price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the area bands and their labels.
AREA_BANDS = ((60.0, "~60이하"), (85.0, "60초과~85이하"), (102.0, "85초과~102이하"), (135.0, "102초과~135이하"))
AREA_ABOVE = "135초과~"
# Amounts below these are taken to be in units of 10,000 won.
THRESHOLDS = {"deposit": 100_000, "rent": 10_000, "maintenance_fee": 10_000}
# Fixed value: square metres of a pyeong.
PYEONG = 3.3058


def area_range(area: Column) -> Column:
    """Label of the half-open area band; null area gives null."""
    out = F.when(area.isNull(), F.lit(None).cast("string"))
    for bound, label in AREA_BANDS:
        out = out.when(area <= bound, label)
    return out.otherwise(AREA_ABOVE)


def converted_price(deposit: Column, monthly: Column, area: Column, existing: Column | None = None) -> Column:
    """``(deposit + 100 * monthly) / area`` rounded to 2; null for area <= 0; an existing price is kept."""
    price = F.when(area > 0, F.round((deposit + monthly * 100.0) / area, 2))
    return price if existing is None else F.coalesce(existing, price)


def _digits(text: Column, pattern: str, group: int = 0) -> Column:
    """The number of a match with its commas taken out; null without a match or digit."""
    return F.regexp_replace(F.regexp_extract(text, pattern, group), ",", "").try_cast("bigint")


def krw_amount(text: Column, fixed: bool = False) -> Column:
    """Won of a Korean amount: the first run of digits times 10,000 (만원), 100,000,000 (억원) or 1.

    ``fixed`` also reads compound amounts such as ``1억 5000만원`` as their sum.
    """
    first = _digits(text, r"[0-9,]+")
    out = F.when(text.contains("만원"), first * 10_000).when(text.contains("억원"), first * 100_000_000).otherwise(first)
    if fixed:
        whole = _digits(text, r"([0-9,]+)\s*억", 1) * 100_000_000 + F.coalesce(_digits(text, r"([0-9,]+)\s*만", 1) * 10_000, F.lit(0))
        out = F.coalesce(whole, out)
    return out


def money_token(text: Column) -> Column:
    """Won of the first ``number 만원`` or ``number 원`` in a text."""
    pattern = r"([0-9][0-9,]*)\s*(만원|원)"
    n = _digits(text, pattern, 1)
    return F.when(F.regexp_extract(text, pattern, 2) == "만원", n * 10_000).otherwise(n)


def area_token(text: Column) -> Column:
    """Square metres of the first area in a text; pyeong are converted."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*(㎡|m2|제곱미터|평)"
    v = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(F.regexp_extract(text, pattern, 2) == "평", v * PYEONG).otherwise(v)


def price_text(text: Column) -> Column:
    """A price label; null where it asks to inquire or says nothing or zero."""
    trimmed = F.trim(text)
    # Words that ask to inquire.
    silent = trimmed.rlike("문의|상담|협의|전화|연락") | trimmed.isin("", "0원", "0")
    return F.when(~silent, trimmed)


def money_range(text: Column) -> Column:
    """struct<low,high>: the first two comma-grouped numbers in order of size; one number is both ends, none gives nulls."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b[0-9]{1,3}(?:,[0-9]{3})+\b"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"))
    a = F.get(found, F.lit(0))
    b = F.coalesce(F.get(found, F.lit(1)), a)
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def fix_anomaly(amount: Column, kind: str) -> Column:
    """Zero becomes null; amounts below the threshold of ``kind``, negative ones too, are multiplied by 10,000."""
    return F.when(amount == 0, F.lit(None)).when(amount < THRESHOLDS[kind], amount * 10_000).otherwise(amount)


def amount_scale(original: Column, normalised: Column) -> Column:
    """Label of the scaling that was applied (the label of 억원 cannot come up: 10,000 is tested first)."""
    ratio = F.try_divide(normalised.cast("double"), original.cast("double"))
    return F.when(ratio >= 10_000, "만원").otherwise("원")


def first_number(text: Column) -> Column:
    """The first run of digits; decimals are dropped."""
    return F.regexp_extract(text, "[0-9]+", 0).try_cast("bigint")


def room_count(text: Column) -> Column:
    """Rooms of a room-type label; 1 where it says nothing."""
    return F.when(text.contains("원룸"), 1).when(text.contains("투룸"), 2).when(text.contains("쓰리룸") | text.contains("3룸"), 3).otherwise(1)


def normalised(score: Column, low: Column, high: Column) -> Column:
    """Min-max normalisation; 0.5 where all scores are equal."""
    return F.when(high == low, 0.5).otherwise(F.try_divide(score - low, high - low))


def token_estimate(text: Column) -> Column:
    """Estimated tokens of a Korean text: a token for each 1.5 characters."""
    return F.floor(F.length(text) / 1.5)
