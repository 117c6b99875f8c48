"""Fields of housing pages: everything is a Column over html or its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

# Housing forms, room shapes, amenities, file extensions of attachments.
FORMS = ("연립주택", "다세대주택", "도시형생활주택", "아파트", "단독주택", "빌라", "오피스텔")
ROOMS = r"[1-4]인[1]?실|원룸\s*\((?:오픈|분리|복층|셰어)형?\)|(?:원룸|투룸|쓰리룸|포룸)\s*형|원룸|투룸|쓰리룸|포룸|[1-4]룸"
AMENITIES = {"parking": "주차", "elevator": "엘리베이터|승강기", "cctv": "(?i)cctv", "laundry": "세탁", "aircon": "에어컨", "internet": "(?i)인터넷|wifi|와이파이", "kitchen": "주방|부엌"}
EXTENSIONS = "pdf|hwp|hwpx|doc|docx|xls|xlsx|zip|jpg|jpeg|png"
SUBWAY = r"(?:([0-9])호선\s*)?([가-힣A-Za-z0-9]+역)(?:\s*(?:도보\s*([0-9]+)\s*분|도보\s*([0-9]+)\s*초|버스\s*([0-9]+)\s*분|([0-9]+)\s*m))?"


def content(html: Column) -> Column:
    """Html without scripts, styles, comments and the page's frame."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|header|footer|nav|aside)\b.*?</\1\s*>|<!--.*?-->", " ")


def plain(html: Column) -> Column:
    return T.without_tags(content(html))


def title(html: Column) -> Column:
    return F.nullif(T.without_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def house_name(page_title: Column, list_title: Column) -> Column:
    """The page's title without its site's name, else the title of the list."""
    cleaned = F.trim(F.regexp_replace(page_title, r"\s*[|\-–:]\s*[^|\-–:]*$", ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), list_title)


def building_form(text: Column) -> Column:
    """The first housing form that a text names, else a room shape, else its first 50 characters."""
    named = F.get(F.filter(F.array(*[F.lit(f) for f in FORMS]), lambda f: text.contains(f)), F.lit(0))
    return F.coalesce(named, F.nullif(F.regexp_extract(text, ROOMS, 0), F.lit("")), F.nullif(F.substring(F.trim(text), 1, 50), F.lit("")))


def last_modified(text: Column) -> Column:
    """The date behind its label, as yyyy-mm-dd."""
    found = F.regexp_extract(text, r"최종수정일\s*:\s*(\d{4}([-./])\d{2}\2\d{2})", 1)
    return F.nullif(F.translate(found, "./", "--"), F.lit(""))


def label_value(html: Column, labels: list[str]) -> Column:
    """The cell after the first header cell that holds one of the labels, in their order."""
    cell = lambda name: T.without_tags(F.regexp_extract(html, rf"(?is)<th[^>]*>[^<]*{name}[^<]*</th>\s*<td[^>]*>(.*?)</td>", 1))
    return F.coalesce(*(F.nullif(cell(name), F.lit("")) for name in labels))


def pairs(html: Column) -> Column:
    """map of header cells to the cells after them; of equal headers the first counts."""
    rows = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>"
    keys = F.transform(F.regexp_extract_all(html, F.lit(rows), F.lit(1)), lambda x: T.without_tags(x))
    values = F.transform(F.regexp_extract_all(html, F.lit(rows), F.lit(2)), lambda x: T.without_tags(x))
    both = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"] != "")
    first = F.filter(both, lambda p, i: F.array_position(F.transform(both, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def address(text: Column, labelled: Column) -> Column:
    """A labelled address, else the first road address, else the first lot address."""
    road = F.regexp_extract(text, r"[가-힣]+(?:특별시|광역시|시|도)\s+[가-힣]+구\s+[가-힣0-9]+(?:로|길)\s*\d+(?:-\d+)?", 0)
    lot = F.regexp_extract(text, r"[가-힣]+(?:특별시|광역시|시|도)\s+[가-힣]+구\s+[가-힣0-9]+동\s+\d+(?:-\d+)?", 0)
    return F.coalesce(F.nullif(F.trim(labelled), F.lit("")), F.nullif(road, F.lit("")), F.nullif(lot, F.lit("")))


def eligibility(text: Column) -> Column:
    """Conditions behind a label, over lines, in parentheses or to the line's end, the first that fits."""
    shapes = (r"(?s)(?:입주자격|신청자격|자격요건|입주대상)\s*[:：]\s*(.+?)(?=\n\s*\n|$)", r"(?:입주자격|신청자격|자격|대상)\s*\(([^)]+)\)", r"(?:자격|대상)\s*[:：]?\s*([^\n]+)")
    return F.coalesce(*(F.nullif(T.squeezed(F.regexp_extract(text, s, 1)), F.lit("")) for s in shapes))


def subway(text: Column) -> Column:
    """array<struct<line,station,access>> of the stations a text names."""
    part = lambda g: F.regexp_extract_all(text, F.lit(SUBWAY), F.lit(g))
    rows = F.arrays_zip(part(1).alias("line"), part(2).alias("station"), part(3).alias("walk"), part(4).alias("sec"), part(5).alias("bus"), part(6).alias("m"))
    said = lambda x: F.nullif(x, F.lit(""))
    access = lambda r: F.coalesce(
        F.concat(F.lit("도보 "), said(r["walk"]), F.lit("분")), F.concat(F.lit("도보 "), said(r["sec"]), F.lit("초")), F.concat(F.lit("버스 "), said(r["bus"]), F.lit("분")), F.concat(said(r["m"]), F.lit("m"))
    )
    return F.transform(rows, lambda r: F.struct(F.concat(said(r["line"]), F.lit("호선")).alias("line"), r["station"].alias("station"), access(r).alias("access")))


def stations(found: Column) -> Column:
    """One label a station, without repeats."""
    return F.array_join(F.array_distinct(F.transform(found, lambda s: F.concat_ws(" ", s["line"], s["station"], s["access"]))), ", ")


def details(text: Column) -> Column:
    """struct<amenities,pet,smoking,bus_lines,distances,money,areas> of free text; lists without repeats, in order."""
    every = lambda p, g=0: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(g)))
    flags = F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in AMENITIES.items()]), lambda k: k.isNotNull())
    pet = F.when(text.rlike(r"(?:반려동물|애완동물)\s*(?:불가|금지)"), "not_allowed").when(text.rlike(r"(?:반려동물|애완동물)\s*(?:가능|허용)"), "allowed")
    lines = F.filter(F.flatten(F.transform(every(r"버스\s*[:：]?\s*([0-9A-Za-z,\s·/-]+)", 1), lambda x: F.split(x, "[^0-9A-Za-z]+"))), lambda x: x != "")
    return F.struct(
        flags.alias("amenities"), pet.alias("pet"), F.when(text.rlike(r"(?:금연|흡연\s*(?:불가|금지))"), "not_allowed").alias("smoking"), F.array_distinct(lines).alias("bus_lines"),
        every(r"(?:도보\s*)?[0-9]+\s*(?:분|초|m\b)").alias("distances"), every(r"[0-9][0-9,]*\s*(?:만원|원)").alias("money"), every(r"([0-9]+(?:\.[0-9]+)?)\s*(?:㎡|m2)", 1).alias("areas"),
    )


def attachments(html: Column, base: Column) -> Column:
    """array<struct<url,name>> of links to files of an allowed kind, absolute; names are hashes of the url."""
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(rf"""(?i)href\s*=\s*["']([^"']+\.(?:{EXTENSIONS}))["']"""), F.lit(1)))
    origin = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    full = lambda u: F.when(u.rlike("(?i)^https?://"), u).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), u))
    return F.transform(links, lambda u: F.struct(full(u).alias("url"), F.concat(F.substring(F.sha2(full(u), 256), 1, 16), F.lit("."), F.lower(F.regexp_extract(u, r"\.([A-Za-z0-9]+)$", 1))).alias("name")))


def announcement(board: str, page_title: Column) -> Column:
    """Whether a board's title is an announcement of the kind wanted."""
    if board == "A":
        return page_title.rlike("모집\\s?공고|입주자\\s?모집")
    return F.lower(page_title).rlike("서울|seoul|수도권")


def occupancy(html: DataFrame, column: str = "html", fixed: bool = True) -> DataFrame:
    """Rows of occupancy tables: page_id, row_no, the cells and ``available``.

    As observed (not ``fixed``) a text that holds 가능, 불가능 too, is available.
    """
    rows = F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.filter(rows, lambda r: r.rlike("(?i)<td")), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: T.without_tags(c)))
    each = html.select("page_id", F.posexplode(cells).alias("row_no", "cells"))
    last = F.element_at("cells", -1)
    yes = last.contains("가능") & ~last.contains("불가") if fixed else last.contains("가능")
    return each.where(F.size("cells") > 0).withColumn("available", F.when(yes, 1).otherwise(0))


def units(notices: DataFrame) -> DataFrame:
    """Units of notices (notice_id, areas, prices as won): areas and prices side by side.

    A unit's deposit is the first price from 1,000,000, its rent the first from 100,000 below the deposit, its fee the first below 100,000.
    """
    price = lambda test: F.get(F.filter("prices", test), F.lit(0))
    deposit = price(lambda p: p >= 1_000_000)
    kept = notices.withColumn("deposit", deposit).withColumn("rent", F.get(F.filter("prices", lambda p: (p >= 100_000) & (p < F.col("deposit"))), F.lit(0)))
    priced = kept.withColumn("fee", price(lambda p: p < 100_000))
    return priced.select("notice_id", F.posexplode_outer("areas").alias("unit_no", "area_m2"), "deposit", "rent", "fee")
