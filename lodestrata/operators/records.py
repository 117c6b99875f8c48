"""Records of facilities, notices, units and tags from raw rows of strings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import address, casts, dates, hashing, money
from lodestrata.functions.codes import lookup


@dataclass(frozen=True)
class Fields:
    """Where a category's raw rows hold what; ``address`` may name a road and a lot column."""

    cd: str
    prefix: str
    name: str
    address: tuple[str, ...]
    phone: str
    website: str = ""
    lat: str = ""
    lon: str = ""
    capacity: str = ""
    grade: str = ""
    hours: tuple[tuple[str, str], ...] = ()
    emergency: str = ""
    extra: dict[str, str] = field(default_factory=dict)


# The raw columns of the ten categories.
CATEGORIES = {
    "childCare": Fields("child", "child", "CRNAME", ("CRADDR",), "CRTELNO", "CRHOME", "LA", "LO", "CRCAPAT", extra={"childcare_type": "CRTYPENAME"}),
    "school": Fields("sch", "sch", "SCHUL_NM", ("ORG_RDNMA",), "ORG_TELNO", "HMPG_ADRES", "LAT", "LON", grade="SCHUL_CRSE_SC_NM",
                     extra={"foundation_type": "FOND_SC_NM", "special_class_exist": "INDST_SPECL_CCCCL_EXST_YN", "high_school_type": "HS_GNRL_BUSNS_SC_NM", "special_purpose": "SPCLY_PURPS_HS_ORD_NM"}),
    "park": Fields("park", "park", "P_PARK", ("P_ADDR",), "P_ADMINTEL", "TEMPLATE_URL", "LATITUDE", "LONGITUDE",
                   extra={"description": "P_LIST_CONTENT", "area": "AREA", "open_date": "OPEN_DT", "main_equipment": "MAIN_EQUIP", "main_plants": "MAIN_PLANTS", "guidance": "GUIDANCE", "visit_road": "VISIT_ROAD", "use_refer": "USE_REFER"}),
    "pharmacy": Fields("pha", "pha", "DUTYNAME", ("DUTYADDR",), "DUTYTEL1", lat="WGS84LAT", lon="WGS84LON", extra={"pharmacy_id": "HOSID", "district": "SIGUN_NM"}),
    "childSchool": Fields("chsch", "chsch", "KDGT_NM", ("ADDR",), "TELNO", "HMPG", capacity="MIX_TDL_CNT", extra={"foundation_type": "FNDN_TYPE"}),
    "college": Fields("col", "col", "NAME_KOR", ("ADD_KOR",), "TEL", "HP", extra={"category": "CATE1_NAME", "branch": "BRANCH", "type": "TYPE"}),
    "gym": Fields("gym", "gym", "시설명", ("시설주소",), "연락처", "홈페이지", capacity="시설규모", hours=(("평일", "운영시간_평일"), ("주말", "운영시간_주말")),
                  extra={k: k for k in ("시설유형", "운영기관", "시설대관여부", "시설사용료", "주차정보", "시설종류", "시설운영상태", "시설편의시설", "비고")}),
    "mart": Fields("mt", "mt", "사업장명", ("도로명전체주소", "소재지전체주소"), "소재지전화", extra={"업태구분명": "업태구분명", "점포구분명": "점포구분명"}),
    "convenience": Fields("con", "con", "사업장명", ("도로명전체주소", "소재지전체주소"), "소재지전화", "홈페이지", extra={"소재지면적": "소재지면적", "도로명전체주소": "도로명전체주소"}),
    "hospital": Fields("hos", "hos", "사업장명", ("도로명전체주소", "소재지전체주소"), "소재지전화", "홈페이지", emergency="진료과목내용명",
                       extra={"진료과목": "진료과목내용명", "의료기관종별": "의료기관종별명", "병상수": "병상수", "의료인수": "의료인수"}),
}
# Keys of nearby facilities and their tags.
TAGS = {"subway_station": "지하철", "subway": "지하철", "bus": "버스", "nearby_마트": "마트", "nearby_병원": "병원", "nearby_학교": "학교", "nearby_시설": "시설", "nearby_카페": "카페"}
THEMES = {"theme": "테마", "subway_station": "지하철", "eligibility": "자격요건"}


def raw_address(f: Fields, there: list[str]) -> Column:
    held = [F.col(c) for c in f.address if c in there]
    if not held:
        return F.lit(None).cast("string")
    return address.road_or_lot(held[0], held[1]) if len(held) > 1 else F.trim(held[0])


def facility(rows: DataFrame, category: str, geocodes: DataFrame | None = None) -> DataFrame:
    """Raw rows of a category in the common shape; columns that a file lacks are blank.

    ``geocodes`` (address, g_lat, g_lon) gives coordinates; a row without both of them is
    dropped, as a failed lookup is. Without the table the file's own coordinates count.
    """
    f, there = CATEGORIES[category], rows.columns
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c and c in there else F.lit("")
    number = lambda c: casts.safe_float(F.col(c)) if c and c in there else F.lit(None).cast("double")
    hours = F.concat_ws(", ", *[F.concat(F.lit(f"{label}: "), text(c)) for label, c in f.hours]) if f.hours else F.lit("")
    based = rows.withColumn("_address", raw_address(f, there))
    if geocodes is not None:
        known = geocodes.where("g_lat IS NOT NULL AND g_lon IS NOT NULL").select(F.col("address").alias("_a"), "g_lat", "g_lon")
        based = based.join(known, F.col("_address") == F.col("_a"))
        lat, lon = F.coalesce(casts.zero_to_null(F.col("g_lat")), number(f.lat)), F.coalesce(casts.zero_to_null(F.col("g_lon")), number(f.lon))
    else:
        lat, lon = number(f.lat), number(f.lon)
    capacity = casts.safe_int(F.col(f.capacity)) if f.capacity in there else F.lit(None).cast("bigint")
    return based.select(
        F.lit(f.cd).alias("cd"), text(f.name).alias("name"), F.col("_address").alias("address_raw"), lat.alias("lat"), lon.alias("lon"), text(f.phone).alias("phone"), text(f.website).alias("website"),
        hours.alias("operating_hours"), F.lit(False).alias("is_24h"), (text(f.emergency).contains("응급") if f.emergency else F.lit(False)).alias("is_emergency"), capacity.alias("capacity"),
        (text(f.grade) if f.grade else F.lit(None).cast("string")).alias("grade_level"), F.to_json(F.struct(*[text(c).alias(k) for k, c in f.extra.items()])).alias("facility_extra"),
    )


def facilities(tables: dict[str, DataFrame], geocodes: DataFrame | None = None) -> DataFrame:
    """All categories as one table."""
    return reduce(DataFrame.unionByName, [facility(df, name, geocodes) for name, df in tables.items()])


def notices(rows: DataFrame, platforms: dict[str, str], other: str) -> DataFrame:
    """Notices from crawled rows (notice_id, house_name, address, building_type, paths, list_url, last_modified, crawl_date)."""
    platform = F.lit(other)
    for mark, code in platforms.items():
        platform = F.when(F.col("notice_id").contains(mark), code).otherwise(platform)
    paths = ("image_paths", "floorplan_paths", "document_paths")
    return rows.select(
        "notice_id", platform.alias("platform_id"), F.coalesce(F.nullif("house_name", F.lit("")), F.col("address")).alias("title"), F.lit("open").alias("status"), F.col("address").alias("address_raw"),
        hashing.address_id(F.nullif("address", F.lit(""))).alias("address_id"), F.coalesce("building_type", F.lit("unknown")).alias("building_type"), F.to_json(F.struct(*paths)).alias("notice_extra"),
        *[casts.present(F.col(p)).alias(f"has_{n}") for p, n in zip(paths, ("images", "floorplan", "documents"), strict=True)], "list_url",
        dates.flexible_timestamp(F.col("last_modified")).alias("posted_at"), dates.flexible_timestamp(F.col("crawl_date")).alias("created_at"),
    )


def units(rows: DataFrame) -> DataFrame:
    """Units from occupancy rows of strings (notice_id, room, area, deposit, rent, fee, floor, people, available_at, available)."""
    area = F.regexp_extract("area", r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    room = F.regexp_replace(F.trim("room"), "호$", "")
    return rows.select(
        "notice_id", hashing.unit_id(F.col("notice_id"), room, F.col("floor"), area).alias("unit_id"), area.alias("area_m2"), money.krw_amount(F.col("deposit")).alias("deposit"), money.krw_amount(F.col("rent")).alias("rent"),
        money.krw_amount(F.col("fee")).alias("maintenance_fee"), room.alias("room_number"), money.first_number(F.col("floor")).alias("floor"), money.first_number(F.col("people")).alias("capacity"),
        dates.flexible_timestamp(F.col("available_at")).alias("occupancy_available_at"), (F.coalesce(F.trim("available"), F.lit("")).isin("1", "true", "가능")).alias("occupancy_available"),
    )


def theme_tags(rows: DataFrame) -> DataFrame:
    """notice_id, tag and description: a row for each of theme, station and eligibility that says something."""
    each = F.array(*[F.when(casts.present(F.col(c)), F.struct(F.lit(tag).alias("tag"), F.trim(c).alias("description"))) for c, tag in THEMES.items()])
    return rows.select("notice_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("t")).select("notice_id", "t.tag", "t.description")


def facility_tags(rows: DataFrame) -> DataFrame:
    """notice_id, tag and description of a map of nearby facilities, without repeats; unknown keys are their own tag."""
    each = rows.select("notice_id", F.explode("facilities").alias("key", "value")).where(casts.present(F.col("value")))
    return each.select("notice_id", F.coalesce(lookup(F.col("key"), TAGS), F.col("key")).alias("tag"), F.trim("value").alias("description")).distinct()


def geocoded(rows: DataFrame, column: str, geocodes: DataFrame, dong: DataFrame) -> DataFrame:
    """Addresses with what a geocode table (address, lat, lon, name) and a code list (name, code) know of them.

    Success needs both coordinates. Region names come from the lookup, else from the first three words of the address.
    """
    g = geocodes.select(F.col("address").alias("_a"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("name").alias("_name"))
    joined = rows.join(g, F.col(column) == F.col("_a"), "left").join(dong.select(F.col("name").alias("_d"), F.col("code").alias("emd_cd")), F.col("_name") == F.col("_d"), "left")
    lat, lon = F.col("_lat").try_cast("double"), F.col("_lon").try_cast("double")
    fine = lat.isNotNull() & lon.isNotNull()
    region = address.split3(F.coalesce(F.when(fine, F.col("_name")), F.col(column)))
    return joined.select(
        *rows.columns, F.when(fine, lat).alias("lat"), F.when(fine, lon).alias("lon"), region["province"].alias("ctpv_nm"), region["district"].alias("sgg_nm"), region["neighbourhood"].alias("emd_nm"),
        F.when(fine, F.col("emd_cd")).alias("emd_cd"), fine.alias("success"),
    )
