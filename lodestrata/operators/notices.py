"""Records of notices from their pages: labelled fields by platform, facilities nearby, related houses, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

# Field -> labels of a line in a notice's text, the first that is there counts.
FIELDS: dict[str, tuple[str, ...]] = {
    "house_name": ("주택명",), "address": ("주소",), "theme": ("테마",), "features": ("특징",), "description": ("설명",),
    "target_occupancy": ("입주대상",), "building_type": ("주거형태",), "unit_type": ("주택유형", "집구조"), "move_in_date": ("입주가능일",), "availability": ("입주가능",),
    "company_name": ("상호",), "representative": ("대표자",), "contact_phone": ("문의전화",), "homepage": ("홈페이지",),
    "deposit": ("보증금",), "monthly_rent": ("월세",), "management_fee": ("관리비",),
    "district_type": ("지역/지구",), "building_scale": (r"규\s*모",), "building_structure": (r"구\s*조",), "site_area": ("대지면적",), "total_floor_area": (r"연\s*면\s*적",),
    "approval_date": ("사용승인",), "parking": (r"주\s*차",), "total_units": (r"총\s*세대",), "total_people": (r"총\s*주거인원",), "total_rooms": (r"총\s*실",),
    "subway_station": ("지하철역",), "bus_info": (r"버스\s*정보",), "nearby_mart": (r"주변\s*마트\s*정보",), "nearby_hospital": (r"주변\s*병원\s*정보",),
    "nearby_school": (r"주변\s*학교\s*정보",), "nearby_facilities": (r"주변\s*시설\s*정보",), "nearby_cafe": (r"주변\s*카페\s*정보",),
}
#: Fields of a platform; those of the youth platform are fewer.
PLATFORMS: dict[str, tuple[str, ...]] = {
    "sohouse": tuple(FIELDS), "cohouse": tuple(FIELDS),
    "youth": ("house_name", "address", "theme", "target_occupancy", "building_type", "unit_type", "subway_station", "bus_info", "availability", "description"),
}
# How a word that names a kind of unit ends, where no label does; values that a page gives to every notice.
UNIT_WORDS, UNSAID = (r"([가-힣a-zA-Z0-9_]+룸)", r"([가-힣a-zA-Z0-9_]+형)"), ("", "-", "주택유형", "집구조")
# Areas, amounts and days in a text.
FACTS = {"areas": r"([0-9]+(?:\.[0-9]+)?)\s*(?:㎡|m²|m2)", "prices": r"(?<![0-9])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{2,})\s*원", "dates": r"([0-9]{4}[.\-/][0-9]{1,2}[.\-/][0-9]{1,2})"}
# Kinds of places in a list of facilities; parts of links to other houses.
NEARBY = ("마트", "병원", "학교", "시설", "카페")
RELATED = {"nearby_housing": "(?:co|so)homeOfTheAreaList", "same_business_housing": "(?:co|so)homeOfTheBizList"}
# Areas and prices in a text, bounds of a deposit and a rent.
AREAS = tuple(r"([0-9]+(?:\.[0-9]+)?)\s*" + unit for unit in ("㎡", "평", "제곱미터"))
PRICES = tuple(r"([0-9]{1,3}(?:,[0-9]{3})*)\s*" + unit for unit in ("만원", "원", "만"))
DEPOSIT, RENT = 1_000_000, 100_000


def line_after(text: Column, label: str) -> Column:
    """The rest of the first line that holds a label and a colon; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"{label}\s*:\s*([^\n]+)", 1)), F.lit(""))


def said(value: Column) -> Column:
    """A value without tags; null if it is blank, a dash or a label."""
    plain = T.without_tags(value)
    return F.when(~plain.isin(*UNSAID), plain)


def field(text: Column, name: str) -> Column:
    """What a notice's text says of a field: behind its labels, or for the kind of unit a word that ends like one."""
    tries = [said(line_after(text, label)) for label in FIELDS[name]]
    if name == "unit_type":
        tries += [said(F.nullif(F.regexp_extract(text, word, 1), F.lit(""))) for word in UNIT_WORDS]
    return F.coalesce(*tries)


def facts(text: Column) -> Column:
    """struct<areas,prices,dates>: the distinct ones of a text, in order; amounts of zeros alone are left out."""
    plain = T.without_tags(F.coalesce(text, F.lit("")))
    found = {name: F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1))) for name, pattern in FACTS.items()}
    found["prices"] = F.filter(found["prices"], lambda x: ~x.rlike("^0+$"))
    return F.struct(*[v.alias(n) for n, v in found.items()])


def private_and_common(text: Column) -> Column:
    """The private and the common area of a unit, as one text; null where a text does not give both."""
    pattern = r"전용\s*([0-9.,]+)\s*m²\s*/\s*공용\s*([0-9.,]+)\s*m²"
    part = lambda g: F.regexp_extract(text, pattern, g)
    return F.when(part(1) != "", F.concat(F.lit("전용 "), part(1), F.lit("m² / 공용 "), part(2), F.lit("m²")))


def platform_records(notices: DataFrame, platform: str) -> DataFrame:
    """notice_id, platform and the fields of a platform's notices (notice_id, platform, detail_text, kv: map of the page's table), from the text or else the table, with ``facts`` and ``area_text``."""
    value = lambda name: F.coalesce(field(F.col("detail_text"), name), said(F.try_element_at("kv", F.lit(name))))
    own = notices.where(F.col("platform") == platform)
    return own.select("notice_id", "platform", *[value(n).alias(n) for n in PLATFORMS[platform]], facts(F.col("detail_text")).alias("facts"), private_and_common(F.col("detail_text")).alias("area_text"))


def unified(notices: DataFrame) -> DataFrame:
    """The records of all platforms in one shape; fields that a platform lacks are null."""
    first, *others = (platform_records(notices, p) for p in PLATFORMS)
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def facilities(html: Column) -> Column:
    """map of subway, bus and nearby places to what a page's list says of each; absent where it says nothing."""
    of_class = lambda name: F.regexp_extract_all(html, F.lit(rf"""(?is)class\s*=\s*["'][^"']*\b{name}\b[^"']*["'][^>]*>\s*<p[^>]*>(.*?)</p>"""), F.lit(1))
    first = lambda name, title: F.get(F.filter(F.transform(of_class(name), lambda x: T.without_tags(x)), lambda x: ~x.isin("", title)), F.lit(0))
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda x: T.without_tags(x))
    found = {"subway": first("subway", "지하철 정보"), "bus": first("bus", "버스 정보")}
    for kind in NEARBY:
        title = f"주변 {kind} 정보"
        found[f"nearby_{kind}"] = _of_item(items, title)
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(v, F.lit("")).alias("value")) for k, v in found.items()]), lambda e: e["value"].isNotNull()))


def _of_item(items: Column, title: str) -> Column:
    item = F.get(F.filter(items, lambda x: x.contains(title)), F.lit(0))
    return F.trim(F.replace(item, F.lit(title), F.lit("")))


def related(html: Column, part: str) -> Column:
    """array<struct<url,title>> of the titled links whose target holds ``part``."""
    anchor = rf"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*{part}[^"']*)["'][^>]*>(.*?)</a>"""
    every = lambda g: F.regexp_extract_all(html, F.lit(anchor), F.lit(g))
    links = F.zip_with(every(1), every(2), lambda u, t: F.struct(u.alias("url"), T.without_tags(t).alias("title")))
    return F.filter(links, lambda x: x["title"] != "")


def _numbers(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in patterns])
    return F.transform(found, lambda x: F.replace(x, F.lit(",")).cast("double"))


def units(notices: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Units of notices (notice_id, detail_text, areas, prices: what was extracted before), with ``fee`` and ``origin``.

    A notice's rows of ``occupancy`` (notice_id, unit_no, area_m2, deposit, rent) count alone;
    without any, areas and prices side by side, those extracted before first, those of the text
    where there are none. With several of either the deposit is the first price from a
    million, else the first; the rent the first from 100,000 below the deposit, else the
    second; with one of each, prices are taken in order. The fee is the first price below
    100,000 that is neither of them.
    """
    has = occupancy.select(F.col("notice_id").alias("o_id")).distinct()
    left = notices.join(has, F.col("notice_id") == F.col("o_id"), "left_anti")
    known = lambda c, p: F.when(F.size(c) > 0, F.col(c)).otherwise(_numbers(F.col("detail_text"), p))
    read = left.select("notice_id", known("areas", AREAS).alias("a"), known("prices", PRICES).alias("p"))
    n = F.greatest(F.size("a"), F.size("p"), F.lit(1))
    price = lambda i: F.get("p", F.lit(i))
    deposit = F.when(n > 1, F.coalesce(F.get(F.filter("p", lambda x: x >= DEPOSIT), F.lit(0)), price(0))).otherwise(price(0))
    priced = read.withColumn("deposit", deposit).withColumn("n", n)
    rent = F.when(F.col("n") > 1, F.coalesce(F.get(F.filter("p", lambda x: (x < F.col("deposit")) & (x >= RENT)), F.lit(0)), price(1))).otherwise(price(1))
    fee = F.get(F.filter("p", lambda x: (x < RENT) & ~x.eqNullSafe(F.col("deposit")) & ~x.eqNullSafe(F.col("rent"))), F.lit(0))
    each = priced.withColumn("rent", rent).withColumn("fee", fee).withColumn("unit_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    area = F.coalesce(F.get("a", F.col("unit_no")), F.get("a", F.lit(0)))
    made = each.select("notice_id", "unit_no", area.alias("area_m2"), "deposit", "rent", "fee", F.lit("text").alias("origin"))
    known_fee = F.col("fee") if "fee" in occupancy.columns else F.lit(None).cast("double")
    return occupancy.select("notice_id", "unit_no", "area_m2", "deposit", "rent", known_fee.alias("fee"), F.lit("occupancy").alias("origin")).unionByName(made)
